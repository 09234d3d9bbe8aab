"""Forward-looking targets over the next months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import month_index
from almanac.functions.scalar import flag as as_flag
from almanac.operators.features import entity_window
from almanac.spec import PanelSpec

# Fixed value: z-score at or below which a month is a severe anomaly.
SEVERE_Z = -1.5


def target_any_flag(df: DataFrame, spec: PanelSpec, flag: str, horizon: int = 3, out: str = "target_3m_stress") -> DataFrame:
    """1 when any of the next rows carries the flag."""
    ahead = entity_window(spec).rowsBetween(1, horizon)
    return df.withColumn(out, as_flag(F.max(flag).over(ahead) == 1))


def target_any_below(
    df: DataFrame, spec: PanelSpec, column: str = "zscore", threshold: float = SEVERE_Z, horizon: int = 3,
    out: str = "target_3m_severe_anomaly",
) -> DataFrame:
    """1 when any of the next rows is at or below the threshold."""
    ahead = entity_window(spec).rowsBetween(1, horizon)
    return df.withColumn(out, as_flag(F.min(column).over(ahead) <= threshold))


def full_horizon(df: DataFrame, spec: PanelSpec, horizon: int = 3) -> DataFrame:
    """Keep rows whose row ``horizon`` ahead lies exactly that many months later."""
    index = month_index(F.col(spec.year), F.col(spec.month_no))
    ahead = F.lead(index, horizon).over(entity_window(spec))
    return df.withColumn("_ahead", ahead).filter(F.col("_ahead") == index + horizon).drop("_ahead")
