"""From a monthly panel to features, episodes, risk, targets and datasets.

One lazy chain. Every step works per entity, so the whole chain needs a single
shuffle on the entity, and the profile at its end needs none of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import CALENDAR_A, CALENDAR_B, SeasonCalendar, season
from almanac.operators import clean, episodes, features, profiles, targets
from almanac.spec import PanelSpec

SPEC = PanelSpec()

# Columns of the training datasets, in order.
BASE_FEATURES = [
    "entity", "year", "month", "season", "measure", "measure_3m", "measure_6m", "measure_12m",
    "historical_mean", "anomaly", "anomaly_pct", "deficit", "missing", "zscore",
]
TEMPORAL_FEATURES = [
    "lag_1m", "lag_2m", "lag_3m", "prev_3m", "prev_6m", "prev_12m", "trend_3m", "month_sin", "month_cos",
]
STRESS_TARGET = "target_3m_stress"
SEVERE_TARGET = "target_3m_severe_anomaly"

# Numeric model inputs (all but entity, month and season).
NUMERIC_FEATURES = [c for c in [*BASE_FEATURES, *TEMPORAL_FEATURES] if c not in ("entity", "month", "season")]
CATEGORICAL_FEATURES = ["month", "season"]


def clean_wide(raw: DataFrame, entity: str) -> DataFrame:
    """Raw wide text to clean wide numbers: names, types, empty and repeated rows."""
    named = clean.standardize_columns(clean.drop_empty_rows(raw))
    numeric = [c for c in named.columns if c != entity]
    typed = clean.coerce_numeric(named, numeric)
    return clean.dedupe_rows(typed.withColumn("year", F.col("year").cast("int")))


def panel_features(panel: DataFrame, spec: PanelSpec = SPEC, reference_period: tuple[int, int] | None = None) -> DataFrame:
    """Rolling sums, baseline, anomaly, deficit and flags."""
    based = features.add_baseline(features.cluster(panel, spec), spec, reference_period)
    rolled = features.rolling_sums(based, spec)
    return features.add_flags(features.add_deficit(features.add_anomaly(rolled, spec), spec), spec)


def standardized(panel: DataFrame, spec: PanelSpec = SPEC, reference_period: tuple[int, int] | None = None) -> DataFrame:
    """Features with z-score and condition."""
    return features.add_zscore(panel_features(panel, spec, reference_period), spec)


def risk_table(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Standardised rows with dry episodes, stress and risk."""
    dry = episodes.dry_episodes(standardized(panel, spec), spec)
    return episodes.add_risk(episodes.add_stress(dry))


def regional_ranking(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Entities ranked by average risk."""
    return profiles.rank_regions(profiles.regional_profile(risk_table(panel, spec), spec), spec)


def seasonal_ranking(panel: DataFrame, spec: PanelSpec = SPEC, calendar: SeasonCalendar = CALENDAR_A) -> DataFrame:
    """Profile per entity and season."""
    return profiles.seasonal_profile(risk_table(panel, spec), spec, calendar)


def model_dataset(panel: DataFrame, spec: PanelSpec = SPEC, calendar: SeasonCalendar = CALENDAR_A) -> DataFrame:
    """All features, episodes, risk and the season, one row per key."""
    return risk_table(panel, spec).withColumn("season", season(F.col(spec.month_no), calendar, strict=True))


def stress_dataset(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows with a full horizon and the persistent-drought target (datasets v1 and v2)."""
    flagged = targets.target_any_flag(model_dataset(panel, spec), spec, "persistent_drought_signal", out=STRESS_TARGET)
    return targets.full_horizon(flagged, spec)


def severe_dataset(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Rows with a full horizon and the severe-anomaly target (dataset v3)."""
    flagged = targets.target_any_below(model_dataset(panel, spec), spec, out=SEVERE_TARGET)
    return targets.full_horizon(flagged, spec)


def temporal_features(df: DataFrame, spec: PanelSpec = SPEC, calendar_mode: bool = False) -> DataFrame:
    """Lags, sums over earlier rows, trend and cyclic month."""
    lagged = features.lags(df, spec, calendar=calendar_mode)
    summed = features.previous_sums(lagged, spec, calendar=calendar_mode)
    return features.add_cyclic_month(features.trend(summed), spec)


def dataset_v1(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Base features with the stress target."""
    return clean.select_features(stress_dataset(panel, spec), [*BASE_FEATURES, STRESS_TARGET])


def dataset_v2(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Base and temporal features without legacy or leaking columns.

    The temporal features are built on the rows that passed the horizon filter.
    """
    rows = clean.drop_leakage(stress_dataset(panel, spec))
    return clean.select_features(temporal_features(rows, spec), [*BASE_FEATURES, *TEMPORAL_FEATURES])


def dataset_v3(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Base features with the severe-anomaly target."""
    return clean.refuse_leakage(clean.select_features(severe_dataset(panel, spec), [*BASE_FEATURES, SEVERE_TARGET]))


def dataset_v4(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Base and temporal features with the severe-anomaly target.

    Target and temporal features come from the same rows in the same windows, so
    what would be a 1:1 join is one projection.
    """
    rows = temporal_features(severe_dataset(panel, spec), spec)
    return clean.refuse_leakage(clean.select_features(rows, [*BASE_FEATURES, *TEMPORAL_FEATURES, SEVERE_TARGET]))


def scoring_rows(panel: DataFrame, spec: PanelSpec = SPEC) -> DataFrame:
    """Dataset v4 with the season of the model stage (December is winter)."""
    rows = dataset_v4(panel, spec)
    return clean.normalize_month_column(rows, "month", "month_no").withColumn(
        "season", season(F.col("month_no"), CALENDAR_B)
    )
