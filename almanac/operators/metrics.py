"""Binary classification metrics, whole or per slice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.scalar import rate
from almanac.operators.distribution import prefix_sums
from almanac.session import stored
from almanac.spec import ScoreSpec

COUNTS = ["true_positive", "false_positive", "false_negative", "true_negative"]


def tally(score: ScoreSpec, condition: Column | None = None) -> Column:
    """How many rows there are, or rows of a condition; a row of a score table stands for several."""
    if score.weight is None:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    weight = F.col(score.weight)
    return F.coalesce(F.sum(weight if condition is None else F.when(condition, weight)), F.lit(0))


def steady_mean(value: Column) -> Column:
    """The mean of a double, whatever the order of the rows.

    A sum of doubles depends on their order in its last digit, which decides how a
    mean that is a tie is rounded. So values are summed as whole numbers of 1e-12,
    in two halves that do not overflow, and what these leave (nothing of a short
    decimal, all of a value above 8) as doubles.
    """
    value = value.cast("double")
    units = F.when(F.abs(value) <= 8, F.rint(value * 1e12)).otherwise(F.lit(0.0))
    high = F.rint(units / 1e6)
    total = F.sum(high.cast("long")).cast("decimal(19,0)") * F.lit(10**6).cast("decimal(7,0)") + F.sum((units - high * 1e6).cast("long")).cast("decimal(19,0)")
    n = F.count(value)
    whole = F.try_divide(total.cast("decimal(28,0)"), n.cast("decimal(19,0)")).cast("double") / 1e12
    return F.when(n > 0, whole + F.try_divide(F.sum(value - units / 1e12), n))


def mean(score: ScoreSpec, value: Column) -> Column:
    """The mean over the rows that have a value."""
    if score.weight is None:
        return steady_mean(value)
    return F.try_divide(F.sum(value * F.col(score.weight)), F.sum(F.when(value.isNotNull(), F.col(score.weight))))


def score_table(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> tuple[DataFrame, ScoreSpec]:
    """Counts per slice, outcome and distinct probability, stored, and the spec that reads them as weighted rows.

    Metrics, sweeps, quantiles, bins and policies at any threshold follow from this
    table, so one scan of the facts serves them all. A table that is weighted
    already is returned as it is.
    """
    if score.weight is not None:
        return df, score
    counts = df.groupBy(*by, score.actual, score.probability).agg(F.count(F.lit(1)).alias("_weight"))
    return stored(counts, "score-table"), replace(score, weight="_weight")


def confusion_aggregates(score: ScoreSpec, alerted: Column) -> list[Column]:
    """The four cells as aggregate expressions."""
    actual = F.col(score.actual)
    return [
        tally(score, (actual == 1) & alerted).alias("true_positive"),
        tally(score, (actual == 0) & alerted).alias("false_positive"),
        tally(score, (actual == 1) & ~alerted).alias("false_negative"),
        tally(score, (actual == 0) & ~alerted).alias("true_negative"),
    ]


def confusion(df: DataFrame, score: ScoreSpec, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts at a threshold (a number or a column)."""
    alerted = F.coalesce(F.col(score.probability) >= threshold, F.lit(False))
    return df.groupBy(*by).agg(*confusion_aggregates(score, alerted))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Rates from confusion counts; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in COUNTS)
    n = tp + fp + fn + tn
    return counts.withColumns(
        {
            "observations": n,
            "events": tp + fn,
            "alerts": tp + fp,
            "event_rate": rate(tp + fn, n),
            "alert_rate": rate(tp + fp, n),
            "precision": rate(tp, tp + fp),
            "recall": rate(tp, tp + fn),
            "f1": rate(2 * tp, 2 * tp + fp + fn),
            "false_positive_rate": rate(fp, fp + tn),
            "false_negative_rate": rate(fn, fn + tp),
            "event_capture_rate": rate(tp, tp + fn),
        }
    )


def score_counts(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking metrics need."""
    p, y = F.col(score.probability), F.col(score.actual)
    known = df.filter(p.isNotNull() & y.isNotNull())
    return known.groupBy(*by, p.cast("double").alias("_score")).agg(
        tally(score, y == 1).alias("pos"), tally(score, y == 0).alias("neg")
    )


def _placed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return prefix_sums(counts, by, "_score", ["pos", "neg"], descending=True)


def _ranking_aggregates(usable: Column) -> list[Column]:
    """Sums over distinct scores from which both ranking metrics follow."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    hits = F.col("pos_before") + pos
    return [
        F.sum(F.when(usable, F.col("pos"))).cast("double").alias("_p"),
        F.sum(F.when(usable, F.col("neg"))).cast("double").alias("_n"),
        F.sum(F.when(usable, F.try_divide(pos * hits, hits + F.col("neg_before") + neg))).alias("_ap"),
        F.sum(F.when(usable, pos * (F.col("neg_before") + neg / 2))).alias("_above"),
    ]


def _ranking_columns() -> dict[str, Column]:
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return {
        "pr_auc": F.when(both, F.col("_ap") / F.col("_p")),
        "roc_auc": F.when(both, 1 - F.col("_above") / (F.col("_p") * F.col("_n"))),
    }


def ranking_metrics(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> DataFrame:
    """Average precision and ROC-AUC with tied scores grouped; NULL for one class.

    Average precision is the sum over distinct scores, high to low, of the recall
    gained times the precision there. ROC-AUC counts the negatives ranked below
    each positive, ties as one half.
    """
    sums = _placed(score_counts(df, score, by), by).groupBy(*by).agg(*_ranking_aggregates(F.lit(True)))
    return sums.withColumns(_ranking_columns()).select(*by, "pr_auc", "roc_auc")


def average_precision(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, by).select(*by, "pr_auc")


def roc_auc(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, by).select(*by, "roc_auc")


def brier_aggregate(score: ScoreSpec) -> Column:
    gap = F.col(score.probability) - F.col(score.actual)
    return mean(score, gap * gap).alias("brier_score")


def brier(df: DataFrame, score: ScoreSpec, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared gap between probability and outcome."""
    return df.groupBy(*by).agg(brier_aggregate(score))


def metrics_by(
    df: DataFrame, score: ScoreSpec, threshold: float | Column, by: Sequence[str] = (), ranking: bool = False
) -> DataFrame:
    """All threshold metrics per slice with mean and maximum probability.

    ``ranking`` adds average precision and ROC-AUC; the threshold is then a number.
    A slice value of NULL is a slice of its own.
    """
    if ranking:
        return _metrics_with_ranking(df, score, float(threshold), by)
    p = F.col(score.probability)
    alerted = F.coalesce(p >= threshold, F.lit(False))
    counts = df.groupBy(*by).agg(
        *confusion_aggregates(score, alerted),
        mean(score, p).alias("average_probability"),
        F.max(p).alias("maximum_probability"),
        brier_aggregate(score),
    )
    return binary_metrics(counts)


def _metrics_with_ranking(df: DataFrame, score: ScoreSpec, threshold: float, by: Sequence[str]) -> DataFrame:
    """One scan for everything: rows become counts per distinct score first.

    A missing probability is a score of its own: it never alerts, so it counts in
    the confusion table and leaves the ranking metrics alone. Scores may be any number.
    """
    y, s = F.col(score.actual), F.col("_score")
    counts = df.groupBy(*by, F.col(score.probability).cast("double").alias("_score")).agg(
        tally(score, y == 1).alias("pos"), tally(score, y == 0).alias("neg"), tally(score).alias("_rows")
    )
    known = s.isNotNull()
    alerted = F.coalesce(s >= threshold, F.lit(False))
    weighed = F.when(known, F.col("_rows"))
    gaps = F.when(known, F.col("pos") * (1 - s) * (1 - s) + F.col("neg") * s * s)
    judged = F.when(known, F.col("pos") + F.col("neg"))

    def total(condition: Column, column: str) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    placed = _placed(counts.where(known), by).unionByName(counts.where(~known), allowMissingColumns=True)
    sums = placed.groupBy(*by).agg(
        total(alerted, "pos").alias("true_positive"),
        total(alerted, "neg").alias("false_positive"),
        total(~alerted, "pos").alias("false_negative"),
        total(~alerted, "neg").alias("true_negative"),
        F.try_divide(F.sum(weighed * s), F.sum(weighed)).alias("average_probability"),
        F.min(F.when(known, s)).alias("minimum_probability"),
        F.max(F.when(known, s)).alias("maximum_probability"),
        F.try_divide(F.sum(gaps), F.sum(judged)).alias("brier_score"),
        *_ranking_aggregates(known),
    )
    return binary_metrics(sums).withColumns(_ranking_columns()).drop("_p", "_n", "_ap", "_above")
