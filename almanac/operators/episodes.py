"""Dry episodes as gaps and islands, and the risk scores built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.calendar import month_index
from almanac.functions.levels import is_dry, risk_level, risk_score, stress_level, stress_score
from almanac.operators.features import entity_window
from almanac.spec import PanelSpec


def add_month_index(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Month counter and whether the previous row is the month before."""
    index = month_index(F.col(spec.year), F.col(spec.month_no))
    previous = F.lag(index).over(entity_window(spec))
    return df.withColumns(
        {"month_index": index, "is_consecutive": F.coalesce(index == previous + 1, F.lit(False)).cast("int")}
    )


def episodes(df: DataFrame, spec: PanelSpec, flag: str = "is_dry") -> DataFrame:
    """Island number per row: a new one when the flag changes or a month is missing."""
    window = entity_window(spec)
    changed = F.col(flag) != F.coalesce(F.lag(flag).over(window), F.lit(0))
    marked = add_month_index(df, spec).withColumn("_new", (changed | (F.col("is_consecutive") == 0)).cast("int"))
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("episode_id", F.sum("_new").over(running)).drop("_new")


def episode_length(df: DataFrame, spec: PanelSpec, flag: str = "is_dry", min_len: int = 3) -> DataFrame:
    """Length of the row's dry run, its length so far, and the persistence signal.

    ``dry_episode_length`` covers the whole run and so knows its future;
    ``running_length`` counts only up to the row.
    """
    island = Window.partitionBy(spec.entity, "episode_id")
    so_far = island.orderBy(spec.year, spec.month_no).rowsBetween(Window.unboundedPreceding, 0)
    sized = df.withColumns(
        {
            "dry_episode_length": F.sum(flag).over(island).cast("int"),
            "running_length": F.sum(flag).over(so_far).cast("int"),
        }
    )
    persistent = (F.col(flag) == 1) & (F.col("dry_episode_length") >= min_len)
    return sized.withColumn("persistent_drought_signal", persistent.cast("int"))


def dry_episodes(df: DataFrame, spec: PanelSpec, min_len: int = 3) -> DataFrame:
    """Dry flag from the condition, then islands and lengths."""
    flagged = df.withColumn("is_dry", is_dry(F.col("condition")))
    return episode_length(episodes(flagged, spec), spec, min_len=min_len)


def add_stress(df: DataFrame) -> DataFrame:
    """Stress score from the shortfall in percent, and its level."""
    scored = df.withColumn("stress_score", stress_score(F.col("anomaly_pct"), F.col("missing")))
    return scored.withColumn("stress_level", stress_level(F.col("stress_score")))


def add_risk(df: DataFrame) -> DataFrame:
    """Risk score from severity, duration and persistence, and its level."""
    score = risk_score(
        F.col("zscore"), F.col("dry_episode_length"), F.col("is_dry"), F.col("persistent_drought_signal")
    )
    return df.withColumn("risk_score", score).withColumn("risk_level", risk_level(F.col("risk_score")))
