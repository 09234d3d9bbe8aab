"""Panel features: baselines, anomalies, rolling sums, lags.

All windows are per entity, or per entity and calendar month, so the one shuffle
on the entity serves every feature. An entity has at most 3612 rows (PanelSpec).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from almanac.functions.calendar import cyclic_month, month_index
from almanac.functions.levels import condition
from almanac.functions.scalar import flag
from almanac.spec import PanelSpec

# Fixed value: shortfall in percent from which a month counts as stressed.
STRESS_PCT = -25.0


def cluster(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One shuffle on the entity, which every later window and profile reuses.

    Without it the planner clusters on (entity, month) for the baseline and then
    again on the entity. Not needed for tables already bucketed by entity.
    """
    return df.repartition(spec.entity)


def entity_window(spec: PanelSpec) -> WindowSpec:
    """An entity's rows in time order. Plain columns, so windows share one sort."""
    return Window.partitionBy(spec.entity).orderBy(spec.year, spec.month_no)


def _frame(spec: PanelSpec, first: int, last: int, calendar: bool) -> WindowSpec:
    """Rows relative to the current one, or months when ``calendar`` is set."""
    if not calendar:
        return entity_window(spec).rowsBetween(first, last)
    months = month_index(F.col(spec.year), F.col(spec.month_no))
    return Window.partitionBy(spec.entity).orderBy(months).rangeBetween(first, last)


def _month_history(spec: PanelSpec) -> WindowSpec:
    """All years of one calendar month; ordered, so float sums repeat exactly."""
    return (
        Window.partitionBy(spec.entity, spec.month_no)
        .orderBy(spec.year)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def _in_period(spec: PanelSpec, period: tuple[int, int] | None) -> Column:
    measure = F.col(spec.measure)
    return measure if period is None else F.when(F.col(spec.year).between(*period), measure)


def climatology(df: DataFrame, spec: PanelSpec, reference_period: tuple[int, int] | None = None) -> DataFrame:
    """Baseline per entity and calendar month, over all years or a given period."""
    x = _in_period(spec, reference_period)
    base = df.groupBy(spec.entity, spec.month_no).agg(
        F.avg(x).alias("historical_mean"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("historical_std"),
        F.min(x).alias("historical_min"),
        F.max(x).alias("historical_max"),
        F.count(x).alias("observations"),
    )
    return base.withColumn(
        "coefficient_of_variation", F.try_divide(F.col("historical_std"), F.col("historical_mean"))
    )


def add_baseline(df: DataFrame, spec: PanelSpec, reference_period: tuple[int, int] | None = None) -> DataFrame:
    """The same baseline as columns, without a join or a second scan."""
    x = _in_period(spec, reference_period)
    history = _month_history(spec)
    return df.withColumns(
        {
            "historical_mean": F.avg(x).over(history),
            "historical_std": F.coalesce(F.stddev_samp(x).over(history), F.lit(0.0)),
        }
    )


def add_monthly_mean(df: DataFrame, spec: PanelSpec, reference_period: tuple[int, int] | None = None) -> DataFrame:
    """Mean of the entity's calendar month on every row."""
    return df.withColumn("historical_mean", F.avg(_in_period(spec, reference_period)).over(_month_history(spec)))


def rolling_sums(df: DataFrame, spec: PanelSpec, lengths: Sequence[int] = (3, 6, 12), calendar: bool = False) -> DataFrame:
    """Sums over the current and the preceding n-1 rows (or months); nulls are skipped."""
    x = F.col(spec.measure)
    return df.withColumns(
        {f"measure_{n}m": F.sum(x).over(_frame(spec, -(n - 1), 0, calendar)) for n in lengths}
    )


def lags(df: DataFrame, spec: PanelSpec, steps: Sequence[int] = (1, 2, 3), calendar: bool = False) -> DataFrame:
    """Values k rows back; in calendar mode the value k months back, NULL at a gap."""
    x = F.col(spec.measure)
    if calendar:
        return df.withColumns({f"lag_{k}m": F.max(x).over(_frame(spec, -k, -k, True)) for k in steps})
    return df.withColumns({f"lag_{k}m": F.lag(x, k).over(entity_window(spec)) for k in steps})


def previous_sums(df: DataFrame, spec: PanelSpec, lengths: Sequence[int] = (3, 6, 12), calendar: bool = False) -> DataFrame:
    """Sums over the n rows (or months) before the current one."""
    x = F.col(spec.measure)
    return df.withColumns({f"prev_{n}m": F.sum(x).over(_frame(spec, -n, -1, calendar)) for n in lengths})


def trend(df: DataFrame) -> DataFrame:
    """Change between the values three months and one month back."""
    return df.withColumn("trend_3m", F.col("lag_1m") - F.col("lag_3m"))


def add_cyclic_month(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumns(cyclic_month(F.col(spec.month_no)))


def add_anomaly(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Difference from the monthly mean, absolute and in percent (NULL at mean 0)."""
    gap = F.col(spec.measure) - F.col("historical_mean")
    return df.withColumns({"anomaly": gap, "anomaly_pct": F.try_divide(gap, F.col("historical_mean")) * 100})


def add_deficit(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """How far the value falls short of the monthly mean, never negative."""
    gap = F.col("historical_mean") - F.col(spec.measure)
    return df.withColumn("deficit", F.when(gap.isNotNull(), F.greatest(gap, F.lit(0.0))))


def add_flags(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Missing value and stressed month as 0/1."""
    return df.withColumns(
        {"missing": F.col(spec.measure).isNull().cast("int"), "stress": flag(F.col("anomaly_pct") <= STRESS_PCT)}
    )


def add_zscore(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Standardised value (NULL at std 0) and its dryness class."""
    z = F.try_divide(F.col(spec.measure) - F.col("historical_mean"), F.col("historical_std"))
    return df.withColumn("zscore", z).withColumn("condition", condition(F.col("zscore")))
