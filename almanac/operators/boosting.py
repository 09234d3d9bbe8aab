"""Boosted trees round by round: staged scores, early stopping with patience, the best prefix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.scalar import sigmoid
from almanac.operators.metrics import ranking_metrics
from almanac.operators.models import fit_gbt
from almanac.session import new_path
from almanac.spec import ScoreSpec

# Settings of the boosted learner with early stopping.
EARLY_STOPPING = {"maxIter": 2000, "maxDepth": 5, "stepSize": 0.03, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
PATIENCE = 75


@dataclass(frozen=True)
class Forest:
    """Trees of an ensemble as arrays ``[tree, node]``; a leaf is its own child, values carry the tree's weight."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @property
    def rounds(self) -> int:
        return len(self.value)

    def cut(self, rounds: int) -> Forest:
        """The first trees only."""
        parts = {n: getattr(self, n)[:rounds] for n in ("feature", "threshold", "left", "right", "value")}
        return replace(self, **parts)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """What each tree adds to each row: all rows go down all trees, one level at a time."""
        trees, node = np.arange(self.rounds)[None, :], np.zeros((len(x), self.rounds), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            # A missing number is not at or below any threshold: it goes right, as in the fitted model.
            down = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(down, self.left[trees, node], self.right[trees, node])
        return self.value[trees, node]

    def _inputs(self) -> Column:
        return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features])

    def staged_margins(self) -> Column:
        """Per row the margin after each round."""

        @F.pandas_udf("array<double>")
        def staged(inputs: pd.Series) -> pd.Series:
            return pd.Series(list(self.outputs(np.stack(inputs.to_numpy())).cumsum(1))) if len(inputs) else pd.Series([], dtype=object)

        return staged(self._inputs())

    def probability(self) -> Column:
        """Probability of the whole ensemble: logistic of twice the margin."""

        @F.pandas_udf("double")
        def margin(inputs: pd.Series) -> pd.Series:
            return pd.Series(self.outputs(np.stack(inputs.to_numpy())).sum(1)) if len(inputs) else pd.Series([], dtype=float)

        return sigmoid(margin(self._inputs()), 2.0, 0.0)


def forest(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> Forest:
    """The trees of a pipeline made by ``fit_gbt``, read from its stored form: trees times nodes, whatever the data."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "trees")
    model.stages[-1].write().save(path)
    cell = F.col("nodeData")
    split = cell["split"]
    threshold = F.coalesce(F.get(split["leftCategoriesOrThreshold"], 0), F.lit(0.0))
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", cell["id"].alias("id"), cell["prediction"].alias("value"), cell["leftChild"].alias("left"), cell["rightChild"].alias("right"),
        split["featureIndex"].alias("feature"), threshold.alias("threshold"),
    ).toPandas()
    weights = np.array(model.stages[-1].treeWeights)
    shape = (len(weights), int(nodes["id"].max()) + 1)
    at = (nodes["treeID"].to_numpy(), nodes["id"].to_numpy())
    own = np.broadcast_to(np.arange(shape[1]), shape)
    table = {"left": own.copy(), "right": own.copy(), "feature": np.zeros(shape, np.int64), "threshold": np.zeros(shape), "value": np.zeros(shape)}
    inner = nodes["left"].to_numpy() >= 0
    for name in ("left", "right", "feature", "threshold"):
        table[name][at[0][inner], at[1][inner]] = nodes[name].to_numpy()[inner]
    table["value"][at] = nodes["value"].to_numpy()
    table["value"] *= weights[:, None]
    return Forest(tuple(features), table["feature"], table["threshold"], table["left"], table["right"], table["value"], model.stages[-1].getMaxDepth())


def staged_quality(trees: Forest, df: DataFrame, target: str) -> DataFrame:
    """``round, pr_auc, roc_auc`` after every round, on the given rows, which are scored once."""
    scored = df.select(F.col(target).alias("actual"), F.posexplode(trees.staged_margins()).alias("_round", "probability"))
    table = ranking_metrics(scored.withColumn("round", F.col("_round") + 1), ScoreSpec(), ["round"])
    return table.select("round", "pr_auc", "roc_auc")


def stop_early(staged: DataFrame, patience: int = PATIENCE, quality: str = "pr_auc") -> DataFrame:
    """``best_round, best_quality, stopped_at``: boosting ends when ``patience`` rounds in a row bring nothing better.

    ``staged`` has one row per round. A round counts only if it is better than all
    before it; without a value it never does. ``stopped_at`` is the last round that
    boosting would have run.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("round")
    q = F.coalesce(F.col(quality), F.lit(float("-inf")))
    before = F.coalesce(F.max(q).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))
    marked = staged.withColumn("_better", F.when(q > before, F.col("round")))
    marked = marked.withColumn("_last", F.coalesce(F.max("_better").over(order), F.min("round").over(order)))
    ended = F.min(F.when(F.col("round") - F.col("_last") >= patience, F.col("round"))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    run = marked.withColumn("_end", F.coalesce(ended, F.max("round").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    chosen = run.where(F.col("round") <= F.col("_end")).agg(F.max("_last").alias("best_round"), F.max("_end").alias("stopped_at"), F.collect_list(F.struct("round", quality)).alias("_all"))
    found = F.filter("_all", lambda r: r["round"] == F.col("best_round"))
    return chosen.select("best_round", F.get(found, 0)[quality].alias("best_quality"), "stopped_at")


def fit_with_patience(
    train: DataFrame, held_out: DataFrame, numeric: Sequence[str], coded: Sequence[str], target: str,
    params: Mapping | None = None, patience: int = PATIENCE,
) -> tuple[Forest, DataFrame]:
    """The ensemble cut to its best prefix on held-out rows, and the quality after each round."""
    features = [*numeric, *coded]
    model = fit_gbt(train, numeric, coded, target, {**EARLY_STOPPING, **(params or {})})
    trees = forest(train, model, features)
    staged = staged_quality(trees, held_out, target)
    best = stop_early(staged, patience).first()
    return trees.cut(best["best_round"]), staged
