"""Choosing alert thresholds and policies from sweep tables.

Sweeps are small: one row per threshold and slice. Selection is by aggregation
(``max_by``), with an explicit last tie-break, and rules are ordered tiers: a row
of a better tier always wins. Functions that choose and functions that report
take separate tables, so a policy can be chosen on one period and reported on
another.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.levels import alert, confusion_label, policy_level
from almanac.operators.joins import apply_season_threshold, union_all
from almanac.operators.metrics import binary_metrics, confusion, metrics_by, score_table
from almanac.operators.ranking import best_row
from almanac.operators.sweep import Grid, GridList, threshold_sweep
from almanac.session import with_row
from almanac.spec import ScoreSpec


@dataclass(frozen=True)
class Limits:
    """Bounds a policy should keep."""

    min_precision: float
    min_recall: float
    max_alert_rate: float


# Limits of the three selection rules and the fallback threshold.
OPERATIONAL_LIMITS = Limits(0.10, 0.30, 0.30)
POLICY_LIMITS = Limits(0.10, 0.30, 0.25)
TWO_TIER_LIMITS = Limits(0.10, 0.40, 1.0)
FALLBACK_THRESHOLD = 0.09

# Reasons written beside a selected policy.
REASON_ALL = "All limits hold; of these thresholds this one has the highest F1."
REASON_FALLBACK = "No threshold keeps every limit; this one has the highest F1 among those that keep the alert rate, if any do."

BY_F1 = [("f1", True), ("precision", True), ("recall", True), ("threshold", True)]


def _meets(limits: Limits) -> Column:
    return (
        (F.col("precision") >= limits.min_precision)
        & (F.col("recall") >= limits.min_recall)
        & (F.col("alert_rate") <= limits.max_alert_rate)
    )


def select_operational(sweep: DataFrame, limits: Limits = OPERATIONAL_LIMITS, partition: Sequence[str] = ()) -> DataFrame:
    """Best F1 among thresholds within all limits, else best F1; lowest threshold on ties."""
    tiered = sweep.withColumn("_tier", F.when(_meets(limits), 1).otherwise(0))
    order = [("_tier", True), ("f1", True), ("threshold", False)]
    best = best_row(tiered, order, partition)
    return best.withColumn("meets_constraints", F.col("_tier") == 1).drop("_tier")


def select_policy(
    sweep: DataFrame, limits: Limits = POLICY_LIMITS, partition: Sequence[str] = (), tie: tuple[str, bool] = ("threshold", False)
) -> DataFrame:
    """Best within all limits, else within the alert rate, else of all; with the reason."""
    tier = F.when(_meets(limits), 2).when(F.col("alert_rate") <= limits.max_alert_rate, 1).otherwise(0)
    order = [("_tier", True), ("f1", True), ("precision", True), ("recall", True), tie]
    best = best_row(sweep.withColumn("_tier", tier), order, partition)
    reason = F.when(F.col("_tier") == 2, REASON_ALL).otherwise(REASON_FALLBACK)
    return best.withColumn("selection_reason", reason).drop("_tier")


def select_two_tier(sweep: DataFrame, limits: Limits = TWO_TIER_LIMITS, partition: Sequence[str] = ()) -> DataFrame:
    """Recall first, then precision where possible; best F1 when recall is out of reach."""
    recall_ok = F.col("recall") >= limits.min_recall
    tier = F.when(recall_ok & (F.col("precision") >= limits.min_precision), 2).when(recall_ok, 1).otherwise(0)
    best = best_row(sweep.withColumn("_tier", tier), [("_tier", True), *BY_F1], partition)
    rule = (
        F.when(F.col("_tier") == 2, "precision_and_recall_constraints")
        .when(F.col("_tier") == 1, "recall_constraint")
        .otherwise("best_f1_fallback")
    )
    return best.withColumn("selection_rule", rule).drop("_tier")


def season_thresholds(df: DataFrame, score: ScoreSpec, grid: Grid | GridList) -> DataFrame:
    """The threshold of best F1 for every season, chosen in one pass."""
    sweep = threshold_sweep(df, score, grid, [score.season])
    order = [("f1", True), ("recall", True), ("precision", True), ("threshold", False)]
    return best_row(sweep, order, [score.season])


def season_policy_metrics(df: DataFrame, score: ScoreSpec, thresholds: DataFrame, fallback: float | None = None) -> DataFrame:
    """Overall metrics when every row is judged by its season's threshold.

    ``df`` may be the score table by season that the thresholds were chosen on.
    """
    judged = apply_season_threshold(df, thresholds, fallback, score.season)
    table = binary_metrics(confusion(judged, score, F.col("season_threshold")))
    return table.withColumn("policy", F.lit("SEASON_AWARE"))


def global_policy_metrics(df: DataFrame, score: ScoreSpec, threshold: float | Column) -> DataFrame:
    """Overall metrics at one threshold."""
    return binary_metrics(confusion(df, score, threshold)).withColumn("policy", F.lit("GLOBAL"))


def compare_policies(global_df: DataFrame, season_df: DataFrame, limits: Limits = POLICY_LIMITS) -> DataFrame:
    """Both policies side by side with the winner under the limits marked."""
    both = union_all(global_df, season_df)
    tier = F.when(_meets(limits), 2).when(F.col("alert_rate") <= limits.max_alert_rate, 1).otherwise(0)
    ranked = both.withColumns({"_tier": tier, "_order": F.when(F.col("policy") == "GLOBAL", 0).otherwise(1)})
    order = [("_tier", True), ("f1", True), ("precision", True), ("recall", True), ("_order", False)]
    winner = best_row(ranked, order).select("policy")
    marked = with_row(both, winner, {"_winner": "policy"})
    return marked.withColumn("selected", F.col("policy") == F.col("_winner")).drop("_winner")


def model_comparison(df: DataFrame, actual: str, columns: Sequence[str]) -> DataFrame:
    """Ranking and calibration quality of several probability columns.

    The columns are unpivoted once, so one scan and one aggregation serve all.
    """
    return compare_quality(_long(df, actual, columns), ScoreSpec(actual=actual))


def _long(df: DataFrame, actual: str, columns: Sequence[str]) -> DataFrame:
    """One row per probability column, told apart by type."""
    return df.select(actual, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [actual], list(columns), "probability_type", "probability"
    )


def probability_table(df: DataFrame, actual: str, columns: Sequence[str]) -> tuple[DataFrame, ScoreSpec]:
    """The score table of several probability columns: comparison and sweeps of all of them from one scan."""
    return score_table(_long(df, actual, columns), ScoreSpec(actual=actual), ["probability_type"])


def compare_quality(long: DataFrame, score: ScoreSpec) -> DataFrame:
    """``model_comparison`` of rows that are told apart by ``probability_type``."""
    table = metrics_by(long, score, FALLBACK_THRESHOLD, ["probability_type"], ranking=True)
    return table.select(
        "probability_type", "observations", "events", "event_rate", "pr_auc", "roc_auc", "brier_score",
        F.col("average_probability").alias("mean_probability"), "minimum_probability", "maximum_probability",
    )


def choose_calibration(quality: DataFrame, kind: str = "probability_type") -> DataFrame:
    """The calibrated probability of lowest Brier score; higher PR-AUC, then the first kind in order, breaks ties."""
    return quality.orderBy(F.col("brier_score").asc_nulls_last(), F.col("pr_auc").desc_nulls_last(), F.col(kind)).limit(1)


def final_policy(quality: DataFrame, selected: DataFrame, calibrated: Sequence[str]) -> DataFrame:
    """The selected threshold of the best calibrated probability type."""
    best = choose_calibration(quality.filter(F.col("probability_type").isin(*calibrated)))
    candidates = with_row(selected, best.select("probability_type"), {"_best": "probability_type"})
    return best_row(candidates.filter(F.col("probability_type") == F.col("_best")).drop("_best"), BY_F1)


def sweep_probabilities(df: DataFrame, actual: str, columns: Sequence[str], grid: Grid | GridList) -> DataFrame:
    """One sweep over several probability columns, told apart by type."""
    return threshold_sweep(_long(df, actual, columns), ScoreSpec(actual=actual), grid, ["probability_type"])


def policy_predictions(df: DataFrame, score: ScoreSpec, threshold: Column | float) -> DataFrame:
    """Every row with its threshold, alert, level relative to it, and error label."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    judged = df.withColumn("final_threshold", limit)
    p = F.col(score.probability)
    alerted = alert(p, F.col("final_threshold"))
    return judged.withColumns(
        {
            "final_alert": alerted,
            "alert_level": policy_level(p, F.col("final_threshold")),
            "correct_prediction": (alerted == F.col(score.actual)).cast("int"),
            "error_type": confusion_label(F.col(score.actual), alerted),
        }
    )


def stability_verdict(by_season: DataFrame, by_period: DataFrame) -> DataFrame:
    """Worst recall and F1 over seasons and periods, and the verdict on them."""
    seasons = by_season.agg(F.min("recall").alias("min_season_recall"), F.min("f1").alias("min_season_f1"))
    periods = by_period.agg(F.min("recall").alias("min_temporal_recall"), F.min("f1").alias("min_temporal_f1"))
    both = with_row(seasons, periods, {c: c for c in periods.columns})
    worst = F.least("min_season_recall", "min_temporal_recall")
    verdict = F.when(worst >= 0.30, "STABLE").when(worst >= 0.15, "MODERATELY_STABLE").otherwise("UNSTABLE")
    return both.withColumn("policy_status", verdict)


def long_report(df: DataFrame, section: str, columns: Sequence[str]) -> DataFrame:
    """One (section, metric, value) row per column, values as text."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], list(columns), "metric", "value").withColumn("section", F.lit(section)).select(
        "section", "metric", "value"
    )
