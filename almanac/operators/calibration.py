"""Probability calibration: sigmoid and isotonic.

Both learners see distinct scores with their counts instead of rows. The fit is
the same, since equal scores share one value, and the fitting table shrinks to
the number of distinct scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.scalar import clip, sigmoid
from almanac.operators.distribution import PIECE_ROWS, in_pieces
from almanac.operators.joins import many_to_one
from almanac.operators.metrics import score_counts
from almanac.session import stored
from almanac.spec import ScoreSpec


@dataclass(frozen=True)
class SigmoidFit:
    """Slope and intercept of the calibration curve."""

    slope: float
    intercept: float

    def apply(self, p: Column) -> Column:
        return sigmoid(p, self.slope, self.intercept)


def _weighted(df: DataFrame, score: ScoreSpec) -> DataFrame:
    """One row per distinct score and outcome, weighted by its count."""
    counts = score_counts(df, score)
    outcome = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("pos").alias("n")), F.struct(F.lit(0.0).alias("label"), F.col("neg").alias("n"))))
    return counts.select(F.col("_score").alias("p"), outcome.alias("o")).select(
        "p", "o.label", F.col("o.n").cast("double").alias("weight")
    ).filter(F.col("weight") > 0)


def fit_sigmoid(df: DataFrame, score: ScoreSpec, c: float = 1.0) -> SigmoidFit:
    """One-feature logistic regression with an L2 penalty of strength 1 / C.

    Spark averages the loss over the total weight, hence the division by it.
    """
    data = _weighted(df, score)
    total = data.agg(F.sum("weight")).first()[0]
    vectors = VectorAssembler(inputCols=["p"], outputCol="features").transform(data)
    model = LogisticRegression(
        weightCol="weight", regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, tol=1e-7, maxIter=200
    ).fit(vectors)
    return SigmoidFit(float(model.coefficients[0]), float(model.intercept))


_BLOCK = "piece int, at long, lo double, hi double, y long, w long"


def _pool(table: pa.Table) -> pa.Table:
    """Blocks in order, with neighbours joined until means rise strictly; compared as whole numbers, so exact."""
    piece = table["piece"][0].as_py()
    blocks: list[list] = []
    for row in zip(*(table.sort_by("lo")[c].to_pylist() for c in ("lo", "hi", "y", "w"))):
        lo, hi, y, w = row
        while blocks and blocks[-1][2] * w >= y * blocks[-1][3]:
            lo, _, before, weight = blocks.pop()
            y, w = y + before, w + weight
        blocks.append([lo, hi, y, w])
    rows = [(piece, i, *b) for i, b in enumerate(blocks)]
    kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["piece", "at", "lo", "hi", "y", "w"])


def _falls(blocks: DataFrame) -> int:
    """Neighbouring pieces whose touching blocks do not rise; one row per piece."""
    block = F.struct("y", "w")
    ends = blocks.groupBy("piece").agg(F.min_by(block, "at").alias("first"), F.max_by(block, "at").alias("last"))
    before = F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("piece"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return ends.select("first", before.alias("before")).where(wide("before.y") * wide("first.w") >= wide("first.y") * wide("before.w")).count()


def _dealt_anew(blocks: DataFrame, piece_rows: int, shift: int) -> DataFrame:
    """The blocks in pieces of ``piece_rows``; the shift moves the cuts between them."""
    counts = blocks.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("at") + shift
    return blocks.join(offsets, "piece").select(F.floor(number / piece_rows).cast("int").alias("piece"), "lo", "hi", "y", "w")


def fit_isotonic(df: DataFrame, score: ScoreSpec, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Monotone calibration as a stored table of blocks ``lo, hi, value, weight``, in rising order.

    Pooled blocks can be pooled again: the fit of two neighbouring stretches is the
    fit of their blocks. Ordered pieces of the distinct scores are pooled side by
    side; while a piece does not rise above the one before it, the blocks are dealt
    to new pieces with shifted cuts and pooled again. No task holds more than a
    piece, and nothing but counts comes to the driver.
    """
    counts = score_counts(df, score).where(~F.isnan("_score")).select(F.col("_score").alias("lo"), F.col("pos").alias("y"), (F.col("pos") + F.col("neg")).alias("w"))
    placed, _ = in_pieces(counts.where("w > 0"), [F.col("lo")], piece_rows)
    current = placed.select(F.col("_piece").alias("piece"), "lo", F.col("lo").alias("hi"), "y", "w")
    rounds = 0
    while True:
        blocks = stored(current.groupBy("piece").applyInArrow(_pool, _BLOCK), "isotonic")
        if not _falls(blocks):
            return blocks.select("lo", "hi", (F.col("y") / F.col("w")).alias("value"), F.col("w").alias("weight"))
        rounds += 1
        current = _dealt_anew(blocks, piece_rows, piece_rows // 2 if rounds % 2 == 0 else 0)


def apply_isotonic(
    df: DataFrame, curve: DataFrame, probability: str, out: str = "isotonic_probability", piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Calibrated probability of every row, on a line between blocks; scores outside the blocks take the end values.

    Distinct scores and block ends are put in one order, in pieces, where each score
    sees the nearest block end on either side; rows then look their score up. A
    missing score, or a curve without blocks, gives NULL.
    """
    p = F.col(probability).cast("double")
    asked = df.select(p.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).select("x", F.lit(None).cast("double").alias("v"))
    ends = curve.select(F.explode(F.array("lo", "hi")).alias("x"), F.col("value").alias("v"))
    points = asked.union(ends).groupBy("x").agg(F.max("v").alias("v"))
    placed, pieces = in_pieces(points, [F.col("x")], piece_rows)
    end = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    inside = Window.partitionBy("_piece").orderBy("x")
    low = F.last(end, ignorenulls=True).over(inside)
    high = F.first(end, ignorenulls=True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = placed.withColumns({"_low": low, "_high": high})
    if pieces > 1:
        found = placed.groupBy("_piece").agg(F.max(end).alias("_last"), F.min(end).alias("_first"))
        all_pieces = Window.partitionBy(F.lit(0)).orderBy("_piece")
        carried = found.select(
            "_piece", F.max("_last").over(all_pieces.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.min("_first").over(all_pieces.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
        table = table.join(F.broadcast(carried), "_piece").withColumns({"_low": F.coalesce("_low", "_before"), "_high": F.coalesce("_high", "_after")})
    low, high = F.coalesce("_low", "_high"), F.coalesce("_high", "_low")
    share = F.coalesce(F.try_divide(F.col("x") - low["x"], high["x"] - low["x"]), F.lit(0.0))
    fitted = table.select(F.col("x").alias("_p"), clip(low["v"] + (high["v"] - low["v"]) * share, 0, 1).alias(out))
    return many_to_one(df.drop(out).withColumn("_p", p), fitted, ["_p"]).drop("_p")
