"""Profiles per entity and season, and target diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import SeasonCalendar, season
from almanac.functions.scalar import rate
from almanac.operators.ranking import order_rank
from almanac.spec import PanelSpec


def regional_profile(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per entity: history, risk, dry and persistent months."""
    profile = df.groupBy(spec.entity).agg(
        F.countDistinct(spec.year).alias("years_observed"),
        F.count(F.lit(1)).alias("observations"),
        F.avg(spec.measure).alias("average_measure"),
        F.avg("risk_score").alias("average_risk_score"),
        F.max("risk_score").alias("maximum_risk_score"),
        F.avg("zscore").alias("average_zscore"),
        F.sum("is_dry").alias("dry_months"),
        F.sum("persistent_drought_signal").alias("persistent_drought_months"),
        F.max("dry_episode_length").alias("maximum_dry_episode"),
    )
    return profile.withColumns(
        {
            "dry_month_pct": F.col("dry_months") / F.col("observations") * 100,
            "persistent_drought_pct": F.col("persistent_drought_months") / F.col("observations") * 100,
        }
    )


def rank_regions(profile: DataFrame, spec: PanelSpec, digits: int = 9) -> DataFrame:
    """Risk rank, highest average first; the entity name breaks ties."""
    keyed = profile.withColumn("_risk", F.round("average_risk_score", digits))
    return order_rank(keyed, by="_risk", tie=[spec.entity], out="risk_rank").drop("_risk")


def seasonal_profile(df: DataFrame, spec: PanelSpec, calendar: SeasonCalendar) -> DataFrame:
    """One row per entity and season."""
    labelled = df.withColumn("season", season(F.col(spec.month_no), calendar, strict=True))
    profile = labelled.groupBy(spec.entity, "season").agg(
        F.countDistinct(spec.year).alias("years_observed"),
        F.count(F.lit(1)).alias("observations"),
        F.avg(spec.measure).alias("average_measure"),
        F.stddev_samp(spec.measure).alias("measure_std"),
        F.avg("zscore").alias("average_zscore"),
        F.min("zscore").alias("minimum_zscore"),
        F.sum("is_dry").alias("dry_months"),
    )
    return profile.withColumn("dry_month_pct", F.col("dry_months") / F.col("observations") * 100)


def target_diagnostics(df: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """Observations, positives and rate for every value of every column in ``by``.

    Rows are first counted per combination, so the grouping sets expand the small
    table of counts and not the data.
    """
    cells = df.groupBy(*by).agg(F.count(target).alias("_n"), F.sum(target).alias("_p"))
    sets = [[F.col(c)] for c in by]
    label = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in by])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in by])
    grouped = cells.groupingSets(sets, *[F.col(c) for c in by]).agg(
        label.alias("dimension"), value.alias("value"),
        F.sum("_n").alias("observations"), F.sum("_p").alias("positives"),
    )
    return grouped.select(
        "dimension", "value", "observations", "positives",
        rate(F.col("positives"), F.col("observations")).alias("positive_rate"),
    )


def class_balance(df: DataFrame, split: str, target: str) -> DataFrame:
    """Rows, positives, negatives and negative-to-positive weight per split."""
    counts = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(F.col(target) == 1).alias("positives"),
        F.count_if(F.col(target) == 0).alias("negatives"),
    )
    return counts.withColumn("scale_pos_weight", F.try_divide(F.col("negatives"), F.col("positives")))
