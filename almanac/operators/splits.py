"""Train / validation / test splits by time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.calendar import valid_year
from almanac.operators.distribution import quantiles
from almanac.session import with_row


def split_by_quantile(df: DataFrame, year: str = "year", q: float = 0.8, out: str = "split") -> DataFrame:
    """TRAIN up to the given quantile of the row years, TEST after it."""
    cut = quantiles(df, [], year, [q]).select(F.col("quantiles")[0].alias("cut"))
    marked = with_row(df, cut, {"_cut": "cut"})
    return marked.withColumn(out, F.when(F.col(year) <= F.col("_cut"), "TRAIN").otherwise("TEST")).drop("_cut")


def split_by_years(
    df: DataFrame, fractions: Sequence[float] = (0.70, 0.85), year: str = "year", out: str = "split"
) -> DataFrame:
    """TRAIN / VALIDATION / TEST by position among the distinct years.

    With n years the cuts lie after int(n * fraction) of them. Valid years are at
    most 301, so numbering them is a bounded window.
    """
    years = df.select(year).filter(valid_year(F.col(year))).distinct()
    everything = Window.partitionBy(F.lit(0))
    numbered = years.select(
        year, F.row_number().over(everything.orderBy(year)).alias("_i"), F.count(F.lit(1)).over(everything).alias("_n")
    )
    cuts = numbered.agg(
        *[
            F.max(F.when(F.col("_i") <= F.floor(F.col("_n") * F.lit(float(f))), F.col(year))).alias(f"_cut{i}")
            for i, f in enumerate(fractions)
        ]
    )
    marked = with_row(df, cuts, {c: c for c in cuts.columns})
    label = F.when(F.col(year) <= F.col("_cut0"), "TRAIN").when(F.col(year) <= F.col("_cut1"), "VALIDATION").otherwise("TEST")
    return marked.withColumn(out, label).drop(*cuts.columns)


def split_by_ranges(df: DataFrame, ranges: Mapping[str, tuple[int, int]], year: str = "year", out: str = "split") -> DataFrame:
    """Label rows by fixed year ranges; other years are dropped, an empty range is refused."""
    label = F.lit(None).cast("string")
    for name, (first, last) in ranges.items():
        label = F.when(F.col(year).between(first, last), name).otherwise(label)
    found = df.agg(*[F.count_if(F.col(year).between(a, b)).alias(n) for n, (a, b) in ranges.items()])
    guarded = with_row(df, found, {f"_n_{n}": n for n in ranges})
    for name in ranges:
        message = F.raise_error(F.lit(f"empty split: {name}")).cast("boolean")
        guarded = guarded.filter(F.when(F.col(f"_n_{name}") > 0, F.lit(True)).otherwise(message))
    return guarded.withColumn(out, label).filter(F.col(out).isNotNull()).drop(*[f"_n_{n}" for n in ranges])
