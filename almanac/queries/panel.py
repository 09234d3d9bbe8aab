"""Features, episodes, risk, profiles, targets, datasets and splits on panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.calendar import add_months, season_name, season_ordinal
from almanac.operators import clean, episodes, features, joins, profiles, ranking, splits, targets
from almanac.plans import panel as plans
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.session import stored
from almanac.sources.adapters import order_panel, quantity_panel, table

SPEC = plans.SPEC
_RISK = [sql.P, *sql.risk("p")]
_RISK_G = [sql.G, *sql.risk("g")]
_TARGETS = [*_RISK, sql.TARGETS]
_TEMPORAL = [*_TARGETS, sql.TEMPORAL]


@query("rolling_sums", final([sql.P, sql.features("p")], "feat", "entity month", "year", "measure measure_3m measure_6m measure_12m"))
def _rolling_sums(spark, directory):
    rolled = features.rolling_sums(quantity_panel(spark, directory), SPEC)
    return rolled.select("entity", "month", "year", "measure", "measure_3m", "measure_6m", "measure_12m")


@query(
    "rolling_sums_calendar",
    final(
        [sql.G, "c AS (SELECT *, year * 12 + month_no AS mi FROM g)",
         """x AS (SELECT entity, month, year, measure,
  sum(measure) OVER (PARTITION BY entity ORDER BY mi RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS measure_3m,
  sum(measure) OVER (PARTITION BY entity ORDER BY mi RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING) AS prev_6m,
  max(measure) OVER (PARTITION BY entity ORDER BY mi RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag_2m FROM c)"""],
        "x", "entity month", "year", "measure measure_3m prev_6m lag_2m",
    ),
)
def _rolling_sums_calendar(spark, directory):
    panel = order_panel(spark, directory)
    rolled = features.rolling_sums(panel, SPEC, (3,), calendar=True)
    lagged = features.lags(features.previous_sums(rolled, SPEC, (6,), calendar=True), SPEC, (2,), calendar=True)
    return lagged.select("entity", "month", "year", "measure", "measure_3m", "prev_6m", "lag_2m")


@query(
    "lags_prev_sums_trend",
    final(
        [sql.P, "tgt AS (SELECT *, year * 12 + month_no AS month_index FROM p)", sql.TEMPORAL],
        "temporal", "entity month", "year", "lag_1m lag_2m lag_3m prev_3m prev_6m prev_12m trend_3m",
    ),
)
def _lags(spark, directory):
    panel = quantity_panel(spark, directory)
    temporal = features.trend(features.previous_sums(features.lags(panel, SPEC), SPEC))
    return temporal.select("entity", "month", "year", "lag_1m", "lag_2m", "lag_3m", "prev_3m", "prev_6m", "prev_12m", "trend_3m")


def _climatology_sql(where: str) -> str:
    inside = f"FILTER (WHERE {where})" if where else ""
    return final(
        [sql.P, f"""c AS (SELECT entity, month_no, avg(measure) {inside} AS historical_mean,
  coalesce(stddev_samp(measure) {inside}, 0) AS historical_std, min(measure) {inside} AS historical_min,
  max(measure) {inside} AS historical_max, count(measure) {inside} AS observations FROM p GROUP BY 1, 2)""",
         "d AS (SELECT *, historical_std / nullif(historical_mean, 0) AS coefficient_of_variation FROM c)"],
        "d", "entity", "month_no observations", "historical_mean historical_std historical_min historical_max coefficient_of_variation",
    )


@query("climatology", _climatology_sql(""))
def _climatology(spark, directory):
    return features.climatology(quantity_panel(spark, directory), SPEC)


@query("climatology_reference_period", _climatology_sql("year BETWEEN 1995 AND 1998"))
def _climatology_period(spark, directory):
    return features.climatology(quantity_panel(spark, directory), SPEC, (1995, 1998))


@query(
    "baseline_join",
    final([sql.P, sql.features("p")], "feat", "entity month", "year", "measure historical_mean historical_std zscore"),
)
def _baseline_join(spark, directory):
    panel = quantity_panel(spark, directory)
    baseline = features.climatology(panel, SPEC).select("entity", "month_no", "historical_mean", "historical_std")
    joined = features.add_zscore(joins.join_baseline(panel, baseline, ["entity", "month_no"]), SPEC)
    return joined.select("entity", "month", "year", "measure", "historical_mean", "historical_std", "zscore")


@query(
    "anomaly_features",
    final(
        [sql.P, sql.features("p")], "feat", "entity month date", "year missing stress",
        "historical_mean anomaly anomaly_pct deficit",
    ).replace('"date"', 'CAST("date" AS VARCHAR) AS "date"'),
)
def _anomaly(spark, directory):
    rows = plans.panel_features(quantity_panel(spark, directory))
    return rows.select("entity", "month", "date", "year", "missing", "stress", "historical_mean", "anomaly", "anomaly_pct", "deficit")


@query("zscore_condition", final([sql.P, sql.features("p")], "feat", "entity month condition", "year", "zscore"))
def _zscore(spark, directory):
    return plans.standardized(quantity_panel(spark, directory)).select("entity", "month", "condition", "year", "zscore")


@query(
    "cyclic_month",
    final(
        [sql.P, "c AS (SELECT *, sin(month_no * 2 * pi() / 12) AS month_sin, cos(month_no * 2 * pi() / 12) AS month_cos FROM p)"],
        "c", "entity month", "year", "month_sin month_cos",
    ),
)
def _cyclic(spark, directory):
    rows = features.add_cyclic_month(quantity_panel(spark, directory), SPEC)
    return rows.select("entity", "month", "year", "month_sin", "month_cos")


_EPISODE_INTS = "year month_index is_consecutive is_dry episode_id dry_episode_length running_length persistent_drought_signal"


def _episodes(panel):
    rows = episodes.dry_episodes(plans.standardized(panel), SPEC)
    return rows.select("entity", "month", "condition", *_EPISODE_INTS.split())


@query("drought_episodes", final(_RISK, "risk", "entity month condition", _EPISODE_INTS))
def _drought(spark, directory):
    return _episodes(quantity_panel(spark, directory))


@query("drought_episodes_gappy", final(_RISK_G, "risk", "entity month condition", _EPISODE_INTS))
def _drought_gappy(spark, directory):
    return _episodes(order_panel(spark, directory))


@query("stress_score", final(_RISK, "risk", "entity month stress_level", "year missing", "anomaly_pct stress_score"))
def _stress(spark, directory):
    rows = episodes.add_stress(plans.panel_features(quantity_panel(spark, directory)))
    return rows.select("entity", "month", "stress_level", "year", "missing", "anomaly_pct", "stress_score")


@query("risk_score", final(_RISK, "risk", "entity month risk_level", "year is_dry", "zscore risk_score"))
def _risk(spark, directory):
    rows = plans.risk_table(quantity_panel(spark, directory))
    return rows.select("entity", "month", "risk_level", "year", "is_dry", "zscore", "risk_score")


_PROFILE = """prof AS (SELECT entity, count(DISTINCT year) AS years_observed, count(*) AS observations, avg(measure) AS average_measure,
  avg(risk_score) AS average_risk_score, max(risk_score) AS maximum_risk_score, avg(zscore) AS average_zscore,
  sum(is_dry) AS dry_months, sum(persistent_drought_signal) AS persistent_drought_months, max(dry_episode_length) AS maximum_dry_episode,
  CAST(sum(is_dry) AS DOUBLE) / count(*) * 100 AS dry_month_pct,
  CAST(sum(persistent_drought_signal) AS DOUBLE) / count(*) * 100 AS persistent_drought_pct FROM risk GROUP BY entity),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(average_risk_score, 9) DESC, entity) AS risk_rank FROM prof)"""
_PROFILE_INTS = "years_observed observations dry_months persistent_drought_months maximum_dry_episode"
_PROFILE_DOUBLES = "average_measure average_risk_score maximum_risk_score average_zscore dry_month_pct persistent_drought_pct"


@query("regional_profile", final([*_RISK, _PROFILE], "prof", "entity", _PROFILE_INTS, _PROFILE_DOUBLES))
def _regional_profile(spark, directory):
    return profiles.regional_profile(plans.risk_table(quantity_panel(spark, directory)), SPEC)


@query("regional_ranking", final([*_RISK, _PROFILE], "ranked", "entity", _PROFILE_INTS + " risk_rank", _PROFILE_DOUBLES))
def regional_ranking(spark, directory):
    return plans.regional_ranking(quantity_panel(spark, directory))


@query(
    "seasonal_profile",
    final(
        [*_RISK, """sp AS (SELECT entity, season, count(DISTINCT year) AS years_observed, count(*) AS observations, avg(measure) AS average_measure,
  stddev_samp(measure) AS measure_std, avg(zscore) AS average_zscore, min(zscore) AS minimum_zscore, sum(is_dry) AS dry_months,
  CAST(sum(is_dry) AS DOUBLE) / count(*) * 100 AS dry_month_pct FROM risk GROUP BY entity, season)"""],
        "sp", "entity season", "years_observed observations dry_months",
        "average_measure measure_std average_zscore minimum_zscore dry_month_pct",
    ),
)
def _seasonal_profile(spark, directory):
    return plans.seasonal_ranking(quantity_panel(spark, directory))


_MODEL_TEXTS = "entity month season condition stress_level risk_level"
_MODEL_INTS = "year missing is_dry dry_episode_length persistent_drought_signal"
_MODEL_DOUBLES = "measure measure_3m measure_6m measure_12m historical_mean anomaly anomaly_pct deficit zscore stress_score risk_score"


@query("model_dataset", final(_RISK, "risk", _MODEL_TEXTS, _MODEL_INTS, _MODEL_DOUBLES))
def _model_dataset(spark, directory):
    rows = plans.model_dataset(quantity_panel(spark, directory))
    return rows.select(*_MODEL_TEXTS.split(), *_MODEL_INTS.split(), *_MODEL_DOUBLES.split())


@query(
    "assemble_join",
    final(_RISK_G, "risk", "entity condition risk_level", "year month_no dry_episode_length", "measure measure_12m zscore risk_score"),
)
def _assemble_join(spark, directory):
    """The same assembly from separate tables, by checked 1:1 joins."""
    # Each part is built from the panel on its own; the facts are read once.
    panel = stored(order_panel(spark, directory), "panel")
    keys = SPEC.keys
    rain = plans.panel_features(panel).select(*keys, "measure", "measure_12m")
    anomaly = plans.standardized(panel).select(*keys, "zscore", "condition")
    risk = stored(plans.risk_table(panel), "risk")
    parts = [anomaly, risk.select(*keys, "dry_episode_length"), risk.select(*keys, "risk_score", "risk_level")]
    return joins.assemble(rain, parts, keys)


@query("target_stress_3m", final(_TARGETS, "tgt", "entity month", "year persistent_drought_signal target_3m_stress"))
def _target_stress(spark, directory):
    rows = plans.stress_dataset(quantity_panel(spark, directory))
    return rows.select("entity", "month", "year", "persistent_drought_signal", "target_3m_stress")


@query("target_severe_3m", final(_TARGETS, "tgt", "entity month", "year target_3m_severe_anomaly", "zscore"))
def _target_severe(spark, directory):
    rows = plans.severe_dataset(quantity_panel(spark, directory))
    return rows.select("entity", "month", "year", "target_3m_severe_anomaly", "zscore")


@query(
    "target_severe_gappy",
    final([*_RISK_G, sql.TARGETS], "tgt", "entity month", "year target_3m_severe_anomaly target_3m_stress"),
)
def _target_gappy(spark, directory):
    panel = order_panel(spark, directory)
    both = targets.target_any_below(plans.model_dataset(panel), SPEC)
    both = targets.target_any_flag(both, SPEC, "persistent_drought_signal")
    return targets.full_horizon(both, SPEC).select("entity", "month", "year", "target_3m_severe_anomaly", "target_3m_stress")


_BASE_DOUBLES = "measure measure_3m measure_6m measure_12m historical_mean anomaly anomaly_pct deficit zscore"
_TEMPORAL_DOUBLES = "lag_1m lag_2m lag_3m prev_3m prev_6m prev_12m trend_3m month_sin month_cos"


@query("dataset_v1", final(_TARGETS, "tgt", "entity month season", "year missing target_3m_stress", _BASE_DOUBLES))
def _dataset_v1(spark, directory):
    return plans.dataset_v1(quantity_panel(spark, directory))


@query("dataset_v2", final(_TEMPORAL, "temporal", "entity month season", "year missing", f"{_BASE_DOUBLES} {_TEMPORAL_DOUBLES}"))
def _dataset_v2(spark, directory):
    return plans.dataset_v2(quantity_panel(spark, directory))


@query("dataset_v3", final(_TARGETS, "tgt", "entity month season", "year missing target_3m_severe_anomaly", _BASE_DOUBLES))
def _dataset_v3(spark, directory):
    return plans.dataset_v3(quantity_panel(spark, directory))


_V4 = final(
    _TEMPORAL, "temporal", "entity month season", "year missing target_3m_severe_anomaly", f"{_BASE_DOUBLES} {_TEMPORAL_DOUBLES}"
)


@query("dataset_v4", _V4)
def _dataset_v4(spark, directory):
    return plans.dataset_v4(quantity_panel(spark, directory))


@query("dataset_v4_join", _V4)
def _dataset_v4_join(spark, directory):
    """The same dataset from a target table and a temporal table, by a checked join."""
    keys = ["entity", "year", "month"]
    severe = stored(plans.severe_dataset(quantity_panel(spark, directory)), "severe")
    target = severe.select(*plans.BASE_FEATURES, plans.SEVERE_TARGET)
    temporal = plans.temporal_features(severe).select(*keys, *plans.TEMPORAL_FEATURES)
    joined = joins.checked_join(target, temporal, keys, "left", "one_to_one")
    return clean.select_features(joined, [*plans.BASE_FEATURES, *plans.TEMPORAL_FEATURES, plans.SEVERE_TARGET])


@query(
    "target_join",
    final(
        [*_TARGETS, "x AS (SELECT entity, year, month, zscore, target_3m_severe_anomaly, CAST(date + INTERVAL 3 MONTH AS DATE) AS horizon FROM tgt)"],
        "x", "entity month horizon", "year target_3m_severe_anomaly", "zscore",
    ).replace('"horizon"', 'CAST("horizon" AS VARCHAR) AS "horizon"'),
)
def _target_join(spark, directory):
    """Features joined 1:1 to their target; a feature row without target would raise."""
    keys = ["entity", "year", "month"]
    severe = plans.severe_dataset(quantity_panel(spark, directory))
    features_ = severe.select(*keys, "zscore", add_months(F.col("date"), 3).alias("horizon"))
    return joins.join_target(features_, severe.select(*keys, plans.SEVERE_TARGET), keys)


@query(
    "target_diagnostics",
    final(
        [*_TARGETS, "d AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(target_3m_stress) AS observations, "
            f"sum(target_3m_stress) AS positives, avg(target_3m_stress) AS positive_rate FROM tgt GROUP BY {c}"
            for c in ("year", "month", "season", "entity")
        ) + ")"],
        "d", "dimension value", "observations positives", "positive_rate",
    ),
)
def _target_diagnostics(spark, directory):
    rows = plans.stress_dataset(quantity_panel(spark, directory))
    return profiles.target_diagnostics(rows, plans.STRESS_TARGET, ["year", "month", "season", "entity"])


_BALANCE = """bal AS (SELECT split, count(*) AS observations, count(*) FILTER (WHERE target_3m_severe_anomaly = 1) AS positives,
  count(*) FILTER (WHERE target_3m_severe_anomaly = 0) AS negatives FROM sp GROUP BY split),
balance AS (SELECT *, CAST(negatives AS DOUBLE) / nullif(positives, 0) AS scale_pos_weight FROM bal)"""


def _split_sql(cte: str) -> str:
    return final([*_TARGETS, cte, _BALANCE], "balance", "split", "observations positives negatives", "scale_pos_weight")


def _dataset(spark, directory):
    return plans.severe_dataset(quantity_panel(spark, directory)).select("entity", "year", "month_no", plans.SEVERE_TARGET)


@query(
    "split_by_year",
    _split_sql("""ys AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM tgt)),
sp AS (SELECT tgt.*, CASE WHEN i <= floor(n * 0.70) THEN 'TRAIN' WHEN i <= floor(n * 0.85) THEN 'VALIDATION' ELSE 'TEST' END AS split
  FROM tgt JOIN ys USING (year))"""),
)
def _split_by_year(spark, directory):
    return profiles.class_balance(splits.split_by_years(_dataset(spark, directory)), "split", plans.SEVERE_TARGET)


@query(
    "split_by_quantile",
    _split_sql(", ".join(sql.quantile_edges("tgt", "cut", "CAST(year AS DOUBLE)", steps="[0.8]")) + """,
sp AS (SELECT tgt.*, CASE WHEN year <= edge THEN 'TRAIN' ELSE 'TEST' END AS split FROM tgt CROSS JOIN cut)"""),
)
def _split_by_quantile(spark, directory):
    return profiles.class_balance(splits.split_by_quantile(_dataset(spark, directory)), "split", plans.SEVERE_TARGET)


@query(
    "split_by_ranges",
    _split_sql("""sp AS (SELECT *, CASE WHEN year BETWEEN 1995 AND 1998 THEN 'TRAIN' WHEN year = 1999 THEN 'VALIDATION' ELSE 'TEST' END AS split
  FROM tgt WHERE year BETWEEN 1995 AND 2001)"""),
)
def _split_by_ranges(spark, directory):
    ranges = {"TRAIN": (1995, 1998), "VALIDATION": (1999, 1999), "TEST": (2000, 2001)}
    return profiles.class_balance(splits.split_by_ranges(_dataset(spark, directory), ranges), "split", plans.SEVERE_TARGET)


@query(
    "ordered_split",
    _split_sql("""sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY year DESC, month_no DESC, entity DESC) <= 400 THEN 'TEST' ELSE 'TRAIN' END AS split
  FROM tgt)"""),
)
def _ordered_split(spark, directory):
    rows = ranking.ordered_split(_dataset(spark, directory), ["year", "month_no", "entity"], 400)
    return profiles.class_balance(rows, "split", plans.SEVERE_TARGET)


@query(
    "semi_join_years",
    """SELECT CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS quantity FROM lineitem
WHERE year(l_shipdate) IN (SELECT DISTINCT year(o_orderdate) FROM orders WHERE o_orderstatus = 'F' GROUP BY year(o_orderdate)) GROUP BY 1""",
)
def _semi_join_years(spark, directory):
    years = table(spark, directory, "orders").filter(F.col("o_orderstatus") == "F").select(F.year("o_orderdate").alias("year")).distinct()
    lines = table(spark, directory, "lineitem").select(F.year("l_shipdate").alias("year"), "l_quantity")
    return joins.keep_keys(lines, years, ["year"]).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query("sorted_panel", final([sql.P], "p", "entity month", "year month_no", "measure"))
def _sorted_panel(spark, directory):
    panel = quantity_panel(spark, directory).select("entity", "month", "year", "month_no", "measure")
    return ranking.sort_panel(panel, ["entity", "year", "month_no"])




@query(
    "season_decode",
    """SELECT l_linenumber % 5 AS code, ['WINTER', 'PRE_MONSOON', 'MONSOON', 'POST_MONSOON'][l_linenumber % 5 + 1] AS season,
  CASE WHEN l_linenumber % 5 < 4 THEN l_linenumber % 5 END AS encoded, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
)
def _season_decode(spark, directory):
    """Season codes back to names, and names to codes again; a code outside the four has no name."""
    lines = table(spark, directory, "lineitem").select((F.col("l_linenumber") % 5).cast("int").alias("code"))
    named = lines.withColumn("season", season_name(F.col("code")))
    return named.groupBy("code", "season", season_ordinal(F.col("season")).alias("encoded")).agg(F.count(F.lit(1)).alias("n"))
