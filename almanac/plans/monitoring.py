"""Monitoring of a scored table and its features, and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.levels import alert, confusion_label, deployment_level
from almanac.operators import checks, drift, slices
from almanac.operators.joins import union_all
from almanac.operators.metrics import score_table
from almanac.spec import ScoreSpec

# Fixed value: the alert threshold of the deployed policy.
POLICY_THRESHOLD = 0.09


def deployment_table(scored: DataFrame, score: ScoreSpec = ScoreSpec(), threshold: float = POLICY_THRESHOLD) -> DataFrame:
    """Scored rows as deployed: clipped probability, alert, level, priority, status."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score.probability)))
    alerted = alert(p, threshold)
    return scored.withColumns(
        {
            "risk_probability": F.when(F.col(score.probability).isNotNull(), p),
            "risk_alert": alerted,
            "risk_level": deployment_level(p),
            "alert_priority": F.when(alerted == 1, deployment_level(p)).otherwise("NONE"),
            "policy_threshold": F.lit(float(threshold)),
            "prediction_status": confusion_label(F.col(score.actual), alerted),
        }
    )


def monitors(
    scored: DataFrame, feature_rows: DataFrame, features: Sequence[str], score: ScoreSpec = ScoreSpec(),
    threshold: float = POLICY_THRESHOLD, periods: drift.Periods = drift.Periods(),
) -> DataFrame:
    """The monitor table of one scored table and one feature table, each scanned once."""
    scored, score = score_table(scored, score, [score.year])
    return drift.monitor_table(
        drift.psi_reference_edges(feature_rows, features, periods),
        slices.probability_summary(scored, score, threshold),
        slices.overall_performance(scored, score, threshold),
        slices.recent_vs_baseline(scored, score, threshold),
    )


def quality_checks(deployed: DataFrame, score: ScoreSpec, keys: Sequence[str]) -> DataFrame:
    """All checks on a deployed table."""
    return union_all(
        checks.key_checks("DEPLOYMENT", deployed, keys, score.month, strict=True),
        checks.one_pass(
            deployed,
            checks.temporal_family("DEPLOYMENT", score.year),
            checks.month_family(deployed, score.month),
            checks.season_family(score.month, score.season),
            checks.missing_family("DEPLOYMENT", deployed.columns),
            checks.probability_family("risk_probability"),
            checks.policy_family("risk_probability", "policy_threshold", "risk_alert"),
        ),
        checks.performance_gates(deployed, ScoreSpec(score.actual, "risk_probability"), POLICY_THRESHOLD),
    )
