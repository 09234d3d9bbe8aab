"""Feature importance: native, permutation, linear contributions, combined."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.linear import LinearModel
from almanac.operators.metrics import ranking_metrics
from almanac.operators.models import add_probability
from almanac.operators.ranking import order_rank, row_rank
from almanac.session import stored
from almanac.spec import ScoreSpec


def native_importance(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Normalised importance of a tree model, ranked. One row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    total = float(values.sum()) or 1.0
    rows = [(f, float(v), float(v) / total) for f, v in zip(features, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double, normalized_importance double")
    return row_rank(table, "importance", ["feature"])


def _shuffled(name: str, seed: int) -> tuple[int, int]:
    """Least factor and shift of the map i -> (factor * i + shift) mod rows."""
    return zlib.crc32(f"{name}/{seed}".encode()) | 1, zlib.crc32(f"{seed}/{name}".encode())


def _coprime(factor: int, rows: int) -> int:
    """The first odd number from ``factor`` on that shares no divisor with ``rows``: the map then moves every row once."""
    while math.gcd(factor, max(rows, 1)) > 1:
        factor += 2
    return factor


def permutation_importance(
    model: PipelineModel | LinearModel, df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """Loss of average precision when one feature's values are shuffled over all rows.

    Rows are numbered once in key order, by pieces, so no task holds them all. A
    shuffle is a fixed one-to-one map of the numbers. Each row sends the values of
    all features and repeats to their new places at once, in one exchange; the row
    there takes them in, and all copies are scored in one job. The number of
    exchanges does not depend on the number of features or repeats.
    """
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    rest = [c for c in df.columns if c not in features]
    named = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *rest, *numbers)
    ranked = order_rank(named, "_k0", [f"_k{i}" for i in range(1, len(keys))], "_i", descending=False)
    numbered = stored(ranked.select("_i", *rest, *features), "numbered")
    rows = numbered.count()
    copies = [(f, r) for f in features for r in range(repeats)]
    sent = []
    for number, (f, r) in enumerate(copies):
        factor, shift = _shuffled(f, seed + r)
        place = (F.lit(_coprime(factor, rows)) * F.col("_i").cast("decimal(19,0)") + shift) % max(rows, 1) + 1
        sent.append(F.struct(place.cast("long").alias("place"), F.lit(number).alias("copy"), F.col(f).alias("value")))
    moved = numbered.select(F.explode(F.array(*sent)).alias("_s")).select("_s.*")
    arrived = moved.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("copy", "value"))).alias("_moved"))
    both = numbered.join(arrived, numbered["_i"] == arrived["place"]).withColumn("_copy", F.explode(F.sequence(F.lit(-1), F.lit(len(copies) - 1))))
    own = {f: [n for n, (name, _) in enumerate(copies) if name == f] for f in features}
    shuffled = both.withColumns({f: F.when(F.col("_copy").isin(own[f]), F.col("_moved")[F.col("_copy")]).otherwise(F.col(f)) for f in features})
    scored = add_probability(model, shuffled, "probability").select(F.col(target).alias("actual"), "probability", "_copy")
    quality = ranking_metrics(scored, ScoreSpec(), ["_copy"])
    # One row per copy; the untouched one, number -1, is the baseline.
    base = F.max(F.when(F.col("_copy") < 0, F.col("pr_auc"))).over(Window.partitionBy(F.lit(0)))
    named = F.get(F.array(*[F.lit(f) for f, _ in copies]), F.col("_copy"))
    loss = quality.withColumn("_loss", base - F.col("pr_auc")).where("_copy >= 0").withColumn("feature", named)
    table = loss.groupBy("feature").agg(
        F.avg("_loss").alias("importance_mean"), F.coalesce(F.stddev_pop("_loss"), F.lit(0.0)).alias("importance_std")
    )
    return row_rank(table, "importance_mean", ["feature"])


def linear_contributions(model: PipelineModel | LinearModel, df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Mean absolute contribution of each numeric feature to the linear score.

    Inputs are standardised, so the exact contribution is weight * (x - mean) / scale.
    """
    linear = model if isinstance(model, LinearModel) else LinearModel.from_pipeline(model, list(numeric))
    terms = df.select(*[F.abs(linear.contribution(f)).alias(f) for f in numeric])
    means = terms.agg(*[F.avg(f).alias(f) for f in numeric]).unpivot([], list(numeric), "feature", "mean_abs_contribution")
    return row_rank(means, "mean_abs_contribution", ["feature"])


def combine_importance(*tables: DataFrame) -> DataFrame:
    """Importance tables side by side, one row per feature of the first."""
    return reduce(lambda left, right: left.join(right, "feature", "left"), tables)
