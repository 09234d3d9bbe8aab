"""Column functions on hand-made values."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanac.functions import calendar, levels, scalar
from almanac.operators import clean


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluate(df, expression):
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_mixed_months(spark):
    df = column(spark, ["JAN", " january ", "1", "12", "0", "13", "XYZ", None, "3.0", "3.5", "sep"], "string")
    assert evaluate(df, calendar.normalize_month(F.col("v"))) == [1, 1, 1, 12, None, None, None, None, 3, None, 9]
    kept = evaluate(df, calendar.normalize_month(F.col("v"), keep_invalid=True))
    assert kept[4:6] == [0, 13]


def test_strict_month_raises(spark):
    df = column(spark, ["JAN", "XYZ"], "string")
    with pytest.raises(PySparkException, match="unknown month: XYZ"):
        evaluate(df, calendar.month_number(F.col("v"), strict=True))


def test_zero_based_months(spark):
    fixed = calendar.fix_zero_based_months(column(spark, list(range(12)), "int"), "v")
    assert sorted(r.v for r in fixed.collect()) == list(range(1, 13))


@pytest.mark.parametrize("values", [list(range(13)), list(range(1, 12)), [0, 1, None]])
def test_ambiguous_months_are_refused(spark, values):
    df = column(spark, values, "int")
    with pytest.raises(PySparkException, match="not a zero-based"):
        calendar.fix_zero_based_months(df, "v").collect()
    kept = calendar.fix_zero_based_months(df, "v", strict=False).orderBy("i").collect()
    assert [r.v for r in kept] == values


def test_calendars_differ_in_december(spark):
    df = column(spark, list(range(1, 13)) + [None], "int")
    a = evaluate(df, calendar.season(F.col("v"), calendar.CALENDAR_A))
    b = evaluate(df, calendar.season(F.col("v"), calendar.CALENDAR_B))
    assert [m + 1 for m in range(12) if a[m] != b[m]] == [12]
    assert (a[11], b[11], b[12]) == ("POST_MONSOON", "WINTER", "UNKNOWN")


def test_month_start(spark):
    df = spark.createDataFrame([(0, 2000, 2), (1, 2000, 13), (2, 1700, 1), (3, None, 1)], "i int, y int, m int")
    assert [str(x) for x in evaluate(df, calendar.month_start(F.col("y"), F.col("m")))] == ["2000-02-01", "None", "None", "None"]


def test_condition_bins_are_right_closed(spark):
    eps = 1e-9
    z = [-2.0, -2 + eps, -1.5, -1.5 + eps, -1.0, -1 + eps, 0.0, eps, None]
    assert evaluate(column(spark, z, "double"), levels.condition(F.col("v"))) == [
        "EXTREME_DRY", "SEVERE_DRY", "SEVERE_DRY", "DRY", "DRY", "BELOW_NORMAL", "BELOW_NORMAL", "NORMAL_OR_WET", None,
    ]


def test_level_edges(spark):
    scores = column(spark, [0.0, 20.0, 40.0, 60.0, 80.0, 100.0], "double")
    assert evaluate(scores, levels.risk_level(F.col("v"))) == ["LOW", "LOW", "MODERATE", "ELEVATED", "HIGH", "CRITICAL"]
    assert evaluate(scores, levels.stress_level(F.col("v")))[-1] == "SEVERE"
    p = column(spark, [0.0, 0.05, 0.09, 0.10, 0.15, 0.25], "double")
    assert evaluate(p, levels.alert_level(F.col("v"))) == ["LOW", "MODERATE", "MODERATE", "ELEVATED", "HIGH", "CRITICAL"]
    assert evaluate(p, levels.deployment_level(F.col("v"))) == ["LOW", "MODERATE", "ELEVATED", "HIGH", "CRITICAL", "CRITICAL"]


def test_relative_levels(spark):
    p = column(spark, [0.04, 0.05, 0.08, 0.1, 0.2, None], "double")
    t = F.lit(0.1)
    assert evaluate(p, levels.policy_level(F.col("v"), t)) == ["NORMAL", "LOW", "WATCH", "HIGH", "HIGH", None]
    assert evaluate(p, levels.inference_level(F.col("v"), t)) == ["NORMAL", "WATCH", "WATCH", "ALERT", "HIGH", None]


def test_stress_and_risk_scores(spark):
    df = spark.createDataFrame(
        [(0, -50.0, 0), (1, None, 1), (2, -300.0, 1), (3, 40.0, 0)], "i int, pct double, missing int"
    )
    assert evaluate(df, levels.stress_score(F.col("pct"), F.col("missing"))) == [40.0, 10.0, 90.0, 0.0]
    risk = spark.createDataFrame(
        [(0, -3.0, 12, 1, 1), (1, None, 3, 0, 0), (2, -1.0, 3, 1, 1), (3, 2.0, 0, 0, 0)], "i int, z double, n int, dry int, p int"
    )
    assert evaluate(risk, levels.risk_score(F.col("z"), F.col("n"), F.col("dry"), F.col("p"))) == [100.0, 0.0, 60.0, 0.0]


def test_stable_sigmoid(spark):
    df = column(spark, [-1e6, -2.0, 0.0, 2.0, 1e6, None], "double")
    got = evaluate(df, scalar.sigmoid(F.col("v"), 1.0, 0.0))
    assert got[0] == 0.0 and got[4] == 1.0 and got[5] is None
    assert got[1:4] == pytest.approx([1 / (1 + math.exp(2)), 0.5, 1 / (1 + math.exp(-2))])


def test_nan_is_null(spark):
    df = column(spark, [float("nan"), 1.0, None], "double")
    assert evaluate(clean.sanitize(df), F.col("v")) == [None, 1.0, None]
    assert evaluate(df, scalar.clip(F.col("v"), 0, 0.5))[2] is None


def test_psi_classes(spark):
    df = column(spark, [0.05, 0.1, 0.25, None, float("nan")], "double")
    assert evaluate(df, levels.psi_class(F.col("v"))) == ["STABLE", "MODERATE_DRIFT", "SIGNIFICANT_DRIFT", "UNAVAILABLE", "UNAVAILABLE"]


def test_period_thirds(spark):
    df = spark.createDataFrame([(y,) for y in (2000, 2001, 2002, 2003)], "year int")
    got = {r.year: r.time_period for r in calendar.period_thirds(df).collect()}
    assert got == {2000: "EARLY", 2001: "EARLY", 2002: "MIDDLE", 2003: "LATE"}


def test_composite_key(spark):
    df = spark.createDataFrame([(0, " a ", None)], "i int, x string, y int")
    assert evaluate(df, scalar.composite_key(df, ["x", "y", "z"])) == ["a|__NA__|__MISSING_COLUMN__"]


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2)], "a int, risk_score int")
    with pytest.raises(ValueError, match="missing columns: \\['b'\\]"):
        clean.require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="leakage"):
        clean.refuse_leakage(df, ["risk_score"])
    assert clean.drop_leakage(df, ["risk_score"]).columns == ["a"]


def test_white_space_of_any_kind_is_stripped(spark):
    df = spark.createDataFrame([("\tJAN\r\n",), (" feb ",)], "m string")
    assert [r[0] for r in df.select(calendar.month_number(F.col("m"))).collect()] == [1, 2]
