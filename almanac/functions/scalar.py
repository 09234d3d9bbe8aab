"""Value-level helpers: clipping, text, keys, safe division, calibration, PSI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: floor for bin shares in PSI.
PSI_EPSILON = 1e-6


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound to [lo, hi]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def no_nan(x: Column) -> Column:
    """NaN to NULL, so that comparisons with it are never true."""
    return F.when(~F.isnan(x), x)


def flag(condition: Column) -> Column:
    """Condition to 0/1, unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the denominator is 0 or missing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def strip(x: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def squash_text(x: Column) -> Column:
    """Trimmed text with every run of blanks as one blank."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def composite_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """Key text joined by a pipe: nulls and absent columns have their own marks."""
    parts = [
        F.coalesce(strip(F.col(c).cast("string")), F.lit("__NA__")) if c in df.columns else F.lit("__MISSING_COLUMN__")
        for c in columns
    ]
    return F.concat_ws("|", *parts)


def sigmoid(p: Column, slope: Column | float, intercept: Column | float) -> Column:
    """Logistic of slope * p + intercept. The input stands in it once: expressions built on it stay small."""
    slope = slope if isinstance(slope, Column) else F.lit(float(slope))
    intercept = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    # Far below zero the exponential is infinite and the quotient 0, as it should be.
    return 1 / (1 + F.exp(-(slope * p + intercept)))


def psi_term(reference: Column, current: Column, epsilon: float = PSI_EPSILON) -> Column:
    """One bin's share of the population stability index."""
    r = F.greatest(reference, F.lit(epsilon))
    c = F.greatest(current, F.lit(epsilon))
    return (c - r) * F.ln(c / r)
