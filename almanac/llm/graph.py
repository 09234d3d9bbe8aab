"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators.joins import many_to_one
from almanac.session import stored


def _state(edges: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; the root is the smallest node of its component.

    Each round replaces edges by edges to smaller neighbours of the same
    component, so the table never outgrows the input. Rounds are written to
    shared storage, which cuts the lineage and survives lost executors. Groupings
    combine map-side and the joins let adaptive execution split a hub. An empty
    table gives an empty result; loops and repeated edges do no harm.
    """
    pairs = edges.where("u <> v")
    current = stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(current)
    for _ in range(rounds):
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = many_to_one(both.where("v > u"), lowest, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is a local minimum keeps its place; edges to itself carry nothing.
        large = stored(large.where("u <> v").distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = many_to_one(large, lowest, ["u"], "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = stored(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
