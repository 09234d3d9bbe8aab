"""Named scales: conditions, stress and risk levels, alert levels, error labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanac.functions.scalar import clip, flag

# Right-closed upper bounds and labels.
CONDITION_BINS = [(-2.0, "EXTREME_DRY"), (-1.5, "SEVERE_DRY"), (-1.0, "DRY"), (0.0, "BELOW_NORMAL")]
CONDITION_TOP = "NORMAL_OR_WET"
DRY_CONDITIONS = ["DRY", "SEVERE_DRY", "EXTREME_DRY"]
STRESS_BINS = [(20.0, "LOW"), (40.0, "MODERATE"), (60.0, "ELEVATED"), (80.0, "HIGH")]
STRESS_TOP = "SEVERE"
RISK_BINS = [(20.0, "LOW"), (40.0, "MODERATE"), (60.0, "ELEVATED"), (80.0, "HIGH")]
RISK_TOP = "CRITICAL"

# The absolute alert scale (upper bounds, exclusive).
ALERT_BINS = [(0.05, "LOW"), (0.10, "MODERATE"), (0.15, "ELEVATED"), (0.25, "HIGH")]
ALERT_TOP = "CRITICAL"

# The deployment scale (lower bounds, inclusive), highest first.
DEPLOYMENT_STEPS = [(0.15, "CRITICAL"), (0.10, "HIGH"), (0.09, "ELEVATED"), (0.05, "MODERATE")]
DEPLOYMENT_ORDER = ["LOW", "MODERATE", "ELEVATED", "HIGH", "CRITICAL"]

# Scales relative to a threshold (multiples, inclusive), highest first.
POLICY_STEPS = [(1.0, "HIGH"), (0.75, "WATCH"), (0.5, "LOW")]
INFERENCE_STEPS = [(2.0, "HIGH"), (1.0, "ALERT"), (0.5, "WATCH")]
RELATIVE_BOTTOM = "NORMAL"

# PSI class bounds and the two label sets.
PSI_MODERATE, PSI_SIGNIFICANT = 0.10, 0.25
PSI_LABELS = {"stable": "STABLE", "moderate": "MODERATE_DRIFT", "significant": "SIGNIFICANT_DRIFT", "missing": "UNAVAILABLE"}
PSI_LABELS_V4 = {"stable": "STABLE", "moderate": "MODERATE", "significant": "SIGNIFICANT", "missing": "UNKNOWN"}


def right_closed(x: Column, bins: Sequence[tuple[float, str]], top: str) -> Column:
    """Label by the first upper bound that x does not exceed; NULL stays NULL."""
    label = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in bins:
        label = label.when(x <= bound, name)
    return label.otherwise(top)


def left_closed(x: Column, bins: Sequence[tuple[float, str]], top: str) -> Column:
    """Label by the first upper bound that x stays below; NULL stays NULL."""
    label = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in bins:
        label = label.when(x < bound, name)
    return label.otherwise(top)


def at_least(x: Column, steps: Sequence[tuple[Column | float, str]], bottom: str) -> Column:
    """Label by the first lower bound that x reaches; NULL stays NULL."""
    label = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, name in steps:
        label = label.when(x >= bound, name)
    return label.otherwise(bottom)


def condition(z: Column) -> Column:
    """Dryness class of a z-score."""
    return right_closed(z, CONDITION_BINS, CONDITION_TOP)


def is_dry(condition_label: Column) -> Column:
    """1 for any of the dry classes, 0 otherwise and for NULL."""
    return flag(condition_label.isin(*DRY_CONDITIONS))


def stress_score(anomaly_pct: Column, missing: Column) -> Column:
    """0..100: 0.8 points per percent of shortfall plus 10 for a missing value."""
    shortfall = F.coalesce(clip(-anomaly_pct, 0, 100), F.lit(0.0))
    return clip(0.8 * shortfall + 10 * missing, 0, 100)


def stress_level(score: Column) -> Column:
    return right_closed(score, STRESS_BINS, STRESS_TOP)


def risk_score(z: Column, length: Column, dry: Column, persistent: Column) -> Column:
    """0..100: severity (50), episode length (30, only when dry), persistence (20)."""
    severity = F.coalesce(clip(-25 * z, 0, 50), F.lit(0.0))
    duration = clip(length.cast("double"), 0, 6) / 6 * 30 * dry
    return clip(severity + duration + 20 * persistent, 0, 100)


def risk_level(score: Column) -> Column:
    return right_closed(score, RISK_BINS, RISK_TOP)


def alert_level(p: Column) -> Column:
    """Absolute alert scale."""
    return left_closed(p, ALERT_BINS, ALERT_TOP)


def deployment_level(p: Column) -> Column:
    """Risk scale of the deployment table."""
    return at_least(p, DEPLOYMENT_STEPS, "LOW")


def policy_level(p: Column, threshold: Column) -> Column:
    """Alert scale relative to the policy threshold."""
    return at_least(p, [(threshold * m, name) for m, name in POLICY_STEPS], RELATIVE_BOTTOM)


def inference_level(p: Column, threshold: Column) -> Column:
    """Risk scale relative to the inference threshold."""
    return at_least(p, [(threshold * m, name) for m, name in INFERENCE_STEPS], RELATIVE_BOTTOM)


def alert(p: Column, threshold: Column | float) -> Column:
    """1 when the probability reaches the threshold."""
    return flag(p >= threshold)


def confusion_label(actual: Column, alerted: Column) -> Column:
    """Name of the confusion cell; anything outside 0/1 is UNKNOWN."""
    return (
        F.when((actual == 1) & (alerted == 1), "TRUE_POSITIVE")
        .when((actual == 0) & (alerted == 0), "TRUE_NEGATIVE")
        .when((actual == 0) & (alerted == 1), "FALSE_POSITIVE")
        .when((actual == 1) & (alerted == 0), "FALSE_NEGATIVE")
        .otherwise("UNKNOWN")
    )


def psi_class(psi: Column, labels: dict[str, str] | None = None) -> Column:
    """Drift class of a PSI value."""
    labels = labels or PSI_LABELS
    return (
        F.when(psi.isNull() | F.isnan(psi), labels["missing"])
        .when(psi >= PSI_SIGNIFICANT, labels["significant"])
        .when(psi >= PSI_MODERATE, labels["moderate"])
        .otherwise(labels["stable"])
    )
