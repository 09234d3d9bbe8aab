"""Ranks, arg-max rows, top-k reports and ordered splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.scalar import rate
from almanac.operators.distribution import PIECE_ROWS, in_pieces, ordered, prefix_sums
from almanac.operators.joins import many_to_one


def _order(by: str, tie: Sequence[str], descending: bool) -> list[Column]:
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return [first, *[F.col(c).asc_nulls_last() for c in tie]]


def order_rank(
    df: DataFrame, by: str, tie: Sequence[str], out: str = "rank", descending: bool = True, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Unique rank 1..n over a table of any size; ``tie`` makes the order total.

    The table is cut into ranges of the full sort key, so equal leading values still
    spread; a row's rank is its place in its piece plus the row count of the earlier
    pieces (one number per piece).
    """
    order = [c for column, down in [(by, descending), *[(c, False) for c in tie]] for c in ordered(F.col(column), down)]
    placed, pieces = in_pieces(df, order, piece_rows)
    if pieces == 1:
        return placed.withColumn(out, F.col("_place")).select(*df.columns, out)
    sizes = placed.groupBy("_piece").agg(F.max("_place").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    # One row per piece: at most MOST_PIECES.
    ranked = placed.join(F.broadcast(offsets), "_piece")
    return ranked.withColumn(out, F.col("_offset") + F.col("_place")).select(*df.columns, out)


def row_rank(df: DataFrame, by: str, tie: Sequence[str], out: str = "rank", descending: bool = True) -> DataFrame:
    """Unique rank of a report table (one row per feature, threshold or check).

    Such tables are bounded by the schema or the grid, so one window task is fine;
    use ``order_rank`` for tables that grow with the data.
    """
    window = Window.partitionBy(F.lit(0)).orderBy(*_order(by, tie, descending))
    return df.withColumn(out, F.row_number().over(window))


def dense_rank_by(df: DataFrame, by: str, out: str = "risk_rank", descending: bool = True) -> DataFrame:
    """Dense rank: equal values share a rank, ranks have no holes.

    Distinct values are ranked by a running count in ordered pieces and joined back.
    """
    distinct = df.groupBy(by).agg(F.lit(1).alias("_one")).filter(F.col(by).isNotNull())
    ranks = prefix_sums(distinct, [], by, ["_one"], descending=descending)
    table = ranks.select(by, (F.col("_one_before") + 1).cast("long").alias(out))
    return many_to_one(df, table, [by]).select(*df.columns, out)


def sort_panel(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Global order by the keys; months sort by number, never by name."""
    return df.orderBy(*keys)


def best_row(df: DataFrame, by: Sequence[tuple[str, bool]], partition: Sequence[str] = ()) -> DataFrame:
    """The arg-max row per group: lexicographic, with (column, descending) pairs.

    The last pair must make the order total. Works by aggregation: no sort, no
    window, and map-side combine leaves one candidate per task and group.
    """
    rest = [c for c in df.columns if c not in partition]
    order = F.struct(*[(F.col(c) if desc else -F.col(c)).alias(f"o{i}") for i, (c, desc) in enumerate(by)])
    best = df.groupBy(*partition).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*partition, *[F.col("_best")[c].alias(c) for c in rest]).select(*df.columns)


def arg_max(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key of the largest value; the smallest key wins a tie. Missing values do not take part."""
    known = df.filter(F.col(value).isNotNull())
    return known.agg(F.min_by(key, F.struct(-F.col(value), F.col(key))).alias(key), F.max(value).alias(value))


def top_slices(df: DataFrame, by: Sequence[tuple[str, bool]], k: int = 15, where: Column | None = None) -> DataFrame:
    """First k rows of a slice table: a top-k report."""
    kept = df if where is None else df.filter(where)
    return kept.orderBy(*[F.col(c).desc() if desc else F.col(c).asc() for c, desc in by]).limit(k)


def top_risk(df: DataFrame, probability: str, tie: Sequence[str], k: int = 100) -> DataFrame:
    """The k riskiest records."""
    return top_slices(df, [(probability, True), *[(c, False) for c in tie]], k)


def top_errors(df: DataFrame, kind: str, probability: str, tie: Sequence[str], k: int = 100, label: str = "error_type") -> DataFrame:
    """The k most confident errors: high false positives or low false negatives."""
    confident_first = kind == "FALSE_POSITIVE"
    return top_slices(df, [(probability, confident_first), *[(c, False) for c in tie]], k, F.col(label) == kind)


def high_risk_alerts(df: DataFrame, alert: str, probability: str, year: str, month: str, tie: Sequence[str] = ()) -> DataFrame:
    """All alerts, highest probability first, then latest; ``tie`` is the rest of the row key."""
    order = [F.col(probability).desc(), F.col(year).desc(), F.col(month).desc(), *[F.col(c).asc_nulls_last() for c in tie]]
    return df.filter(F.col(alert) == 1).orderBy(*order)


def high_risk_ranked(df: DataFrame, probability: str, threshold: float, tie: Sequence[str]) -> DataFrame:
    """Records at or above the threshold with their rank."""
    return order_rank(df.filter(F.col(probability) >= threshold), probability, tie, "risk_rank")


def ordered_split(df: DataFrame, order: Sequence[str], test_rows: int, out: str = "split") -> DataFrame:
    """Label the last ``test_rows`` rows in key order TEST and the others TRAIN.

    ``order`` must be a key. The boundary key is the smallest of the top
    ``test_rows``: a top-k, not a numbering of the table.
    """
    key = F.struct(*[F.col(c) for c in order])
    last = df.select(key.alias("_key")).orderBy(F.col("_key").desc()).limit(test_rows)
    boundary = last.agg(F.min("_key")).scalar()
    return df.withColumn(out, F.when(key >= boundary, "TEST").otherwise("TRAIN"))


def composition(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every value of a label column (closed label set)."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percentage", rate(F.col("count"), total))
