"""Exact running sums, ranks and quantiles that never sort a whole group in one task.

Running sums and ranks work on ordered pieces: ranges of the whole key, so that they
are even however the values crowd.
Piece totals give each piece its offset; the work inside a piece is local.
Quantiles work on a monotone bucket of the value instead. Results are exact:
pieces and buckets only decide where work happens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.joins import null_safe_join
from almanac.session import stored

# Rows that one piece should hold, and the most pieces there are.
PIECE_ROWS = 50_000
MOST_PIECES = 4096
# Logarithmic buckets for values: 16384 per e-fold of magnitude.
_FOLD_BUCKETS = 16384


def ordered(value: Column, descending: bool = False) -> list[Column]:
    """Columns whose ascending order is the order of a number; NULL is last, NaN counts as the largest."""
    if not descending:
        return [value.isNull(), value]
    return [value.isNull(), F.when(F.isnan(value.cast("double")), 0).otherwise(1), -value]


def in_pieces(df: DataFrame, order: Sequence[Column], piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, int]:
    """The table, stored once, with the number of its ordered piece in ``_piece`` and the place there, from 1, in ``_place``; and how many pieces there are.

    The keys in ``order`` should be distinct. The table is written first, so what
    stands before it runs once and range partitioning samples a file. Numbers are
    written with the rows, so every later pass sees the same pieces.
    """
    kept = stored(df, "ordered")
    rows = kept.count()
    pieces = max(1, min(MOST_PIECES, -(-rows // piece_rows)))
    ranged = kept.repartitionByRange(pieces, *order) if pieces > 1 else kept.coalesce(1)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ranged.sortWithinPartitions(*order).withColumns({"_piece": F.spark_partition_id(), "_place": place})
    return (stored(placed, "pieces") if pieces > 1 else placed), pieces


def value_bucket(v: Column) -> Column:
    """Monotone bucket of any finite value: signed, logarithmic in magnitude."""
    x = v.cast("double")
    magnitude = F.floor(F.log1p(F.abs(x) * 1e9) * _FOLD_BUCKETS).cast("long")
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def even_steps(bins: int) -> list[float]:
    """0, 1/bins, ... 1 as multiples of the step.

    0.1 * 3 is not the same double as 0.3. Bin edges often hit data values, so the
    last digit decides on which side a row falls.
    """
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def interpolate(low: Column, high: Column, share: Column) -> Column:
    """Linear interpolation measured from the nearer end, so that equal ends give that value."""
    span = high - low
    return F.when(share >= 0.5, high - span * (1 - share)).otherwise(low + span * share)


def _over(keys: Sequence[str]) -> list:
    return [F.col(k) for k in keys] or [F.lit(0)]


def prefix_sums(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Add ``<name>_before``: the sum over all rows that precede in value order.

    ``df`` must hold one row per (keys, value), the usual result of a groupBy.
    """
    order = ordered(F.col(value), descending)
    placed, pieces = in_pieces(df, [*[F.col(k) for k in keys], *order], piece_rows)
    within = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {s: F.coalesce(F.sum(s).over(within), F.lit(0)) for s in sums}
    if pieces == 1:
        return placed.withColumns({f"{s}_before": c for s, c in local.items()}).drop("_piece", "_place")
    totals = placed.groupBy(*keys, "_piece").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    # At most one row per piece and group: a bounded window.
    earlier = Window.partitionBy(*_over(keys)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_piece", *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums]
    )
    joined = null_safe_join(placed, offsets, keys, equal=["_piece"])
    return joined.withColumns({f"{s}_before": F.col(f"_{s}_offset") + c for s, c in local.items()}).drop(
        "_piece", "_place", *[f"_{s}_offset" for s in sums]
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    out: str = "quantiles",
    bounded_keys: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation: one array per group, plus ``n``.

    With ``weight`` a row counts as so many rows of its value.

    First pass: a histogram over value buckets, combined map-side. It tells which
    buckets hold the wanted ranks. Second pass: only rows of those buckets are
    counted by value and searched. The filter table has at most two rows per
    wanted quantile and group; ``bounded_keys`` states that the number of groups
    is bounded too (features, years, seasons), which makes it a broadcast.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    clean = df.select(*keys, F.col(value).cast("double").alias("_v"), times.alias("_w")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    placed = clean.withColumn("_bucket", value_bucket(F.col("_v")))
    group = Window.partitionBy(*_over(keys))
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    histogram = placed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_n"))
    located = histogram.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(running), F.lit(0)), "_total": F.sum("_n").over(group)}
    )

    def position(q: float) -> Column:
        # By way of percent, as the usual data-frame libraries do; it can move the
        # last digit (0.7000000000000001 becomes 0.7).
        return (F.col("_total") - 1) * F.lit(float(q) * 100 / 100)

    def low(q: float) -> Column:
        return F.floor(position(q)).cast("long")

    def high(q: float) -> Column:
        return F.ceil(position(q)).cast("long")

    def covers(rank: Column, count: str = "_n") -> Column:
        return (rank >= F.col("_before")) & (rank < F.col("_before") + F.col(count))

    wanted = F.lit(False)
    for q in probs:
        wanted = wanted | covers(low(q)) | covers(high(q))
    hits = located.filter(wanted).select(*keys, "_bucket", F.col("_before").alias("_offset"), "_total")
    if bounded_keys or not keys:
        hits = F.broadcast(hits)
    counts = (
        null_safe_join(placed, hits, keys, equal=["_bucket"])
        .groupBy(*keys, "_bucket", "_offset", "_total", "_v")
        .agg(F.sum("_w").alias("_n"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    picks = []
    for i, q in enumerate(probs):
        picks.append(F.max(F.when(covers(low(q)), F.col("_v"))).alias(f"_lo{i}"))
        picks.append(F.max(F.when(covers(high(q)), F.col("_v"))).alias(f"_hi{i}"))
    ends = ranked.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    values = [
        interpolate(F.col(f"_lo{i}"), F.col(f"_hi{i}"), position(q) - F.floor(position(q))) for i, q in enumerate(probs)
    ]
    return ends.select(*keys, F.array(*values).alias(out), F.col("_total").alias("n"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float], bounded_keys: bool = False, weight: str | None = None) -> DataFrame:
    """Quantiles as named columns."""
    q = quantiles(df, keys, value, list(named.values()), bounded_keys=bounded_keys, weight=weight)
    return q.select(*keys, "n", *[F.col("quantiles")[i].alias(name) for i, name in enumerate(named)])
