"""Metrics for a whole grid of thresholds in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.operators.metrics import binary_metrics, tally
from almanac.spec import ScoreSpec


@dataclass(frozen=True)
class Grid:
    """Thresholds start, start+step, ... stop in thousandths.

    Integer steps avoid the drift of repeated float addition: every threshold is
    exactly k / 1000.
    """

    start: int
    stop: int
    step: int

    def __len__(self) -> int:
        return (self.stop - self.start) // self.step + 1

    def value(self, index: Column) -> Column:
        return (F.lit(self.start) + index * self.step).cast("double") / F.lit(1000.0)

    def passed(self, p: Column) -> Column:
        """How many thresholds the probability reaches (inclusive)."""
        guess = F.floor((p * 1000.0 - self.start) / self.step).cast("long")
        # The guess can be off by one through rounding; the comparison decides.
        highest = (
            F.when(self.value(guess + 1) <= p, guess + 1).when(self.value(guess) <= p, guess).otherwise(guess - 1)
        )
        count = F.greatest(F.lit(0), F.least(F.lit(len(self)), highest + 1))
        return F.coalesce(count, F.lit(0)).cast("int")


@dataclass(frozen=True)
class GridList:
    """A short explicit list of thresholds, ascending."""

    values: tuple[float, ...]

    def __len__(self) -> int:
        return len(self.values)

    def value(self, index: Column) -> Column:
        return F.array(*[F.lit(float(v)) for v in self.values])[index.cast("int")]

    def passed(self, p: Column) -> Column:
        total = F.lit(0)
        for v in self.values:
            total = total + F.coalesce(p >= F.lit(float(v)), F.lit(False)).cast("int")
        return total


# The grids in use.
GRID_FINE = Grid(10, 500, 10)
GRID_ALERT = Grid(20, 150, 10)
GRID_POLICY = Grid(10, 170, 5)
GRID_V4 = Grid(10, 500, 5)
GRID_SENSITIVITY = Grid(50, 150, 10)


def threshold_sweep(df: DataFrame, score: ScoreSpec, grid: Grid | GridList, by: Sequence[str] = ()) -> DataFrame:
    """One row per slice and threshold with all threshold metrics.

    A row is counted once, under the number of thresholds it reaches. That leaves
    at most len(grid) + 1 rows per slice; only those are repeated per threshold.
    """
    y = F.col(score.actual)
    cells = (
        df.filter(y.isNotNull())
        .groupBy(*by, grid.passed(F.col(score.probability)).alias("_passed"))
        .agg(tally(score, y == 1).alias("_pos"), tally(score, y == 0).alias("_neg"))
    )
    spread = cells.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    reached = F.col("_passed") > F.col("_t")
    counts = spread.groupBy(*by, "_t").agg(
        F.sum(F.when(reached, F.col("_pos")).otherwise(0)).alias("true_positive"),
        F.sum(F.when(reached, F.col("_neg")).otherwise(0)).alias("false_positive"),
        F.sum(F.when(reached, 0).otherwise(F.col("_pos"))).alias("false_negative"),
        F.sum(F.when(reached, 0).otherwise(F.col("_neg"))).alias("true_negative"),
    )
    table = binary_metrics(counts).withColumn("threshold", grid.value(F.col("_t")))
    rest = [c for c in table.columns if c not in {*by, "_t", "threshold"}]
    return table.select(*by, "threshold", *rest)
