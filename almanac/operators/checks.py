"""Data-quality checks as rows, and the release decision over them.

Every check is an aggregate; a table is scanned once per kind of question. The
result rows are (section, check, status, value, details), all text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import (
    CALENDAR_B,
    SEASONS,
    UNKNOWN,
    SeasonCalendar,
    normalize_month,
    season,
    valid_month,
    valid_probability,
    valid_year,
)
from almanac.functions.levels import PSI_MODERATE, PSI_SIGNIFICANT
from almanac.functions.scalar import flag, rate
from almanac.operators.joins import semi_filter, union_all
from almanac.operators.metrics import metrics_by
from almanac.session import with_row
from almanac.spec import ScoreSpec

PASS, REVIEW, FAIL = "PASS", "REVIEW", "FAIL"
CHECK_COLUMNS = ["section", "check", "status", "value", "details"]

# How many offending values the text of a check spells out; ``offending_values`` has all of them.
_LISTED = 50


@dataclass(frozen=True)
class Gates:
    """Limits a model has to meet."""

    min_pr_auc: float
    min_roc_auc: float
    min_precision: float
    min_recall: float
    min_f1: float
    max_brier: float


# Performance gates, alert-rate range, features left out of the drift gate.
GATES = Gates(0.10, 0.70, 0.10, 0.25, 0.15, 0.10)
ALERT_RATE_RANGE = (0.01, 0.50)
DRIFT_EXCLUDED = ["year"]


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value.cast("string")


def _fixed(value: Column) -> Column:
    """Six decimals of the value as it is stored: a tie of its shortest decimal form is seldom one of the number, and a true one goes to even."""
    exact = F.call_function("format_number", value, F.lit("0.000000"))
    return F.when(F.abs(value) < float("inf"), exact).otherwise(F.format_string("%.6f", value))


def _row(section: str, check: str | Column, status: Column, value: Column | str = "", details: Column | str = "") -> Column:
    return F.struct(
        F.lit(section).alias("section"), _text(check).alias("check"), status.alias("status"),
        _text(value).alias("value"), _text(details).alias("details"),
    )


def _rows(facts: DataFrame, *rows: Column) -> DataFrame:
    """Check rows from one row of facts."""
    return facts.select(F.inline(F.array(*rows)))


def _when(condition: Column, otherwise: str = FAIL) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), PASS).otherwise(otherwise)


def offending_values(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Every distinct value outside a closed domain, with its number of rows."""
    outside = F.col(column).isNotNull() & ~F.col(column).isin(*domain)
    return df.filter(outside).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def _listing(values: DataFrame, column: str) -> Column:
    """Distinct values as text: a top-k report, with a hint when there are more.

    The whole list is a table of its own, see ``offending_values``.
    """
    distinct = values.select(F.col(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    first = distinct.orderBy("_v").limit(_LISTED + 1).agg(F.sort_array(F.collect_list("_v")).alias("a"))
    text = F.concat_ws(", ", F.slice("a", 1, _LISTED).cast("array<string>"))
    return first.select(F.concat(text, F.when(F.size("a") > _LISTED, " and more").otherwise(""))).scalar()


def missing_rates(df: DataFrame) -> DataFrame:
    """Share of nulls per column, from one aggregate over all columns."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column", "missing_rate")


def worst_missing(df: DataFrame) -> DataFrame:
    """The column of highest missing rate; the first column wins a tie."""
    position = {c: i for i, c in enumerate(df.columns)}
    order = F.coalesce(*[F.when(F.col("column") == c, F.lit(-i)) for c, i in position.items()])
    return missing_rates(df).agg(
        F.max("missing_rate").alias("maximum_rate"), F.max_by("column", F.struct(F.col("missing_rate"), order)).alias("worst_column")
    )


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeated keys: number of keys, rows in them, and surplus rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("rows_in_repeated_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
    )


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return semi_filter(df, repeated, keys)


def domain_check(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Rows and values outside a closed domain, as one row."""
    outside = ~F.coalesce(F.col(column).isin(*domain), F.lit(False))
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(column).isNull()).alias("null_rows"),
        F.count_if(outside & F.col(column).isNotNull()).alias("outside_rows"),
    )
    listed = _listing(df.filter(outside), column)
    return facts.withColumns({"outside_values": listed, "status": _when(F.col("outside_rows") == 0)})


def integrity_checks(
    tables: Mapping[str, DataFrame], target_table: str, target: str, feature_table: str, required: Sequence[str]
) -> DataFrame:
    """Target present, binary and with a rate; required features; exact duplicates."""
    section = "DATASET INTEGRITY"
    results = []
    data = tables[target_table]
    spark = data.sparkSession
    if target in data.columns:
        y = F.col(target).try_cast("double")
        facts = data.agg(
            F.count_if(y == 1).alias("positive"), F.count_if(y == 0).alias("negative"),
            F.count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("other"),
        )
        counts = F.concat(F.lit("positive="), F.col("positive"), F.lit(", negative="), F.col("negative"))
        share = rate(F.col("positive"), F.col("positive") + F.col("negative"))
        results.append(
            _rows(
                facts,
                _row(section, "TARGET COLUMN", F.lit(PASS)),
                _row(section, "TARGET BINARY VALIDATION", _when(F.col("other") == 0), counts),
                _row(section, "TARGET RATE", F.lit(PASS), _fixed(share)),
            )
        )
    else:
        results.append(_rows(spark.range(1), _row(section, "TARGET COLUMN", F.lit(FAIL))))
    absent = [c for c in required if c not in tables[feature_table].columns]
    details = "All required features present" if not absent else ", ".join(absent)
    results.append(
        _rows(spark.range(1), _row(section, "REQUIRED FEATURE SCHEMA", F.lit(FAIL if absent else PASS), "", details))
    )
    for name, table in tables.items():
        surplus = duplicate_counts(table, table.columns)
        check = f"{name} EXACT DUPLICATES"
        results.append(_rows(surplus, _row(section, check, _when(F.col("surplus_rows") == 0, REVIEW), F.col("surplus_rows"))))
    return union_all(*results)


def key_checks(name: str, df: DataFrame, keys: Sequence[str], month: str, strict: bool) -> DataFrame:
    """Null keys, repeated keys and invalid months. Strict tables fail, others are reviewed.

    All three are properties of the key, so one grouping by key answers them.
    """
    section = "KEY STRUCTURE"
    bad = FAIL if strict else REVIEW
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    # By the columns themselves: joined text would merge keys that differ.
    groups = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(any_null).alias("_null"),
        F.count_if(~valid_month(normalize_month(F.col(month)))).alias("_bad_month"),
    )
    facts = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_null"), F.lit(0)).alias("null_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated"),
        F.coalesce(F.sum("_bad_month"), F.lit(0)).alias("bad_months"),
    )
    null_rate = F.concat(F.lit("rate="), _fixed(rate(F.col("null_rows"), F.col("rows"))))
    return _rows(
        facts,
        _row(section, f"{name} NULL KEY ROWS", _when(F.col("null_rows") == 0, bad), null_rate),
        _row(section, f"{name} UNIQUE KEY", _when(F.col("repeated") == 0, bad), F.concat(F.lit("groups="), F.col("repeated"))),
        _row(section, f"{name} INVALID MONTH ROWS", _when(F.col("bad_months") == 0, bad), F.col("bad_months")),
    )


@dataclass(frozen=True)
class Family:
    """Checks answered by global aggregates: the facts, and the rows made of them."""

    facts: list[Column]
    rows: list[Column]


def one_pass(df: DataFrame, *families: Family) -> DataFrame:
    """Check rows of several families from a single scan of the table."""
    facts = df.agg(*[f for family in families for f in family.facts])
    return _rows(facts, *[r for family in families for r in family.rows])


def temporal_family(name: str, year: str = "year") -> Family:
    y = F.col(year).try_cast("int")
    ok = F.col("_bad_years") == 0
    span = F.when(ok, F.concat_ws("-", F.col("_first_year").cast("string"), F.col("_last_year").cast("string"))).otherwise("")
    return Family(
        [F.count_if(~valid_year(y)).alias("_bad_years"), F.min(y).alias("_first_year"), F.max(y).alias("_last_year")],
        [
            _row("TEMPORAL", f"{name} YEAR VALIDITY", _when(ok), F.col("_bad_years")),
            _row("TEMPORAL", f"{name} YEAR RANGE", _when(ok), span),
        ],
    )


def temporal_checks(name: str, df: DataFrame, year: str = "year") -> DataFrame:
    """Years within the valid range, and the range found."""
    return one_pass(df, temporal_family(name, year))


def month_family(df: DataFrame, month: str = "month") -> Family:
    m = normalize_month(F.col(month), keep_invalid=True)
    listed = _listing(df.select(m.alias("_m")).filter(~valid_month(F.col("_m"))), "_m")
    ok = F.col("_bad_months") == 0
    return Family(
        [
            F.count(F.lit(1)).alias("_month_rows"),
            F.count_if(~valid_month(m)).alias("_bad_months"),
            F.count_if(m == 0).alias("_zero_months"),
        ],
        [
            _row("MONTH", "INVALID MONTH COUNT", _when(ok), F.col("_bad_months")),
            _row("MONTH", "INVALID MONTH RATE", _when(ok), _fixed(rate(F.col("_bad_months"), F.col("_month_rows")))),
            _row("MONTH", "INVALID MONTH VALUES", _when(ok), listed),
            _row("MONTH", "MONTH ZERO RECORDS", _when(F.col("_zero_months") == 0), F.col("_zero_months")),
        ],
    )


def month_checks(df: DataFrame, month: str = "month") -> DataFrame:
    """Invalid months: count, rate, values and zeros."""
    return one_pass(df, month_family(df, month))


def season_family(month: str = "month", column: str = "season", calendar: SeasonCalendar = CALENDAR_B) -> Family:
    existing = F.upper(F.trim(F.coalesce(F.col(column), F.lit(UNKNOWN))))
    derived = season(normalize_month(F.col(month)), calendar)
    return Family(
        [
            F.count_if(existing == UNKNOWN).alias("_unknown_seasons"),
            F.count_if(~existing.isin(*SEASONS)).alias("_other_seasons"),
            F.count_if(existing != derived).alias("_wrong_seasons"),
        ],
        [
            _row("SEASON", check, _when(F.col(c) == 0), F.col(c))
            for check, c in [
                ("UNKNOWN SEASONS", "_unknown_seasons"), ("SEASON DOMAIN", "_other_seasons"),
                ("MONTH SEASON CONSISTENCY", "_wrong_seasons"),
            ]
        ],
    )


def season_checks(df: DataFrame, month: str = "month", column: str = "season", calendar: SeasonCalendar = CALENDAR_B) -> DataFrame:
    """Unknown seasons, values outside the domain, seasons that contradict the month."""
    return one_pass(df, season_family(month, column, calendar))


def missing_family(name: str, columns: Sequence[str]) -> Family:
    facts = [F.avg(F.col(c).isNull().cast("int")).alias(f"_missing_{i}") for i, c in enumerate(columns)]
    top = F.array_max(F.array(*[F.coalesce(F.col(f"_missing_{i}"), F.lit(0.0)) for i in range(len(columns))]))
    worst = F.coalesce(*[F.when(F.col(f"_missing_{i}") == top, F.lit(c)) for i, c in enumerate(columns)])
    row = _row(
        "MISSING VALUES", f"{name} MISSING VALUE RATE", _when(top == 0, REVIEW), _fixed(top),
        F.when(top > 0, worst).otherwise(""),
    )
    return Family(facts, [row])


def missing_checks(name: str, df: DataFrame) -> DataFrame:
    """Highest missing rate of any column; missing values ask for review only."""
    return one_pass(df, missing_family(name, df.columns))


def probability_family(column: str) -> Family:
    section, p = "PROBABILITY", F.col(column).try_cast("double")
    return Family(
        [
            F.count_if(p.isNull()).alias("_null_p"),
            F.count_if(p.isNotNull() & ~valid_probability(p)).alias("_outside_p"),
            F.min(p).alias("_min_p"), F.max(p).alias("_max_p"),
        ],
        [
            _row(section, "PROBABILITY COLUMN", F.lit(PASS), column),
            _row(section, "PROBABILITY NULL", _when(F.col("_null_p") == 0), F.col("_null_p")),
            _row(section, "PROBABILITY RANGE", _when(F.col("_outside_p") == 0), F.col("_outside_p")),
            _row(section, "PROBABILITY MINIMUM", F.lit(PASS), _fixed(F.col("_min_p"))),
            _row(section, "PROBABILITY MAXIMUM", F.lit(PASS), _fixed(F.col("_max_p"))),
        ],
    )


def probability_checks(df: DataFrame, column: str) -> DataFrame:
    """Probability present, not null, within 0..1, with its range."""
    if column not in df.columns:
        return _rows(df.sparkSession.range(1), _row("PROBABILITY", "PROBABILITY COLUMN", F.lit(FAIL), "", "Column missing"))
    return one_pass(df, probability_family(column))


def policy_family(probability: str, threshold: str, alert: str, alert_range: tuple[float, float] = ALERT_RATE_RANGE) -> Family:
    t = F.col(threshold)
    expected = flag(F.col(probability) >= t)
    found = F.coalesce(F.col(alert).cast("int"), F.lit(-999))
    alert_rate = F.col("_alert_rate")
    return Family(
        [
            F.count_if(~valid_probability(t)).alias("_bad_threshold"),
            F.count_if(expected != found).alias("_alert_errors"),
            F.avg(found).alias("_alert_rate"),
        ],
        [
            _row("POLICY", "POLICY THRESHOLD", _when(F.col("_bad_threshold") == 0), f"column={probability}"),
            _row("POLICY", "POLICY ALERT CONSISTENCY", _when(F.col("_alert_errors") == 0), F.col("_alert_errors")),
            _row("POLICY", "ALERT RATE", _when(alert_rate.between(*alert_range), REVIEW), _fixed(alert_rate)),
        ],
    )


def policy_checks(df: DataFrame, probability: str, threshold: str, alert: str, alert_range: tuple[float, float] = ALERT_RATE_RANGE) -> DataFrame:
    """Threshold valid, alerts equal p >= threshold, alert rate within range."""
    return one_pass(df, policy_family(probability, threshold, alert, alert_range))


def performance_gates(df: DataFrame, score: ScoreSpec, threshold: float, gates: Gates = GATES) -> DataFrame:
    """Model quality against its limits."""
    facts = metrics_by(df, score, threshold, [], ranking=True)

    def gate(check: str, column: str, passed: Column) -> Column:
        return _row("PERFORMANCE", check, _when(passed), F.coalesce(_fixed(F.col(column)), F.lit("")))

    return _rows(
        facts,
        gate("PR-AUC", "pr_auc", F.col("pr_auc") >= gates.min_pr_auc),
        gate("ROC-AUC", "roc_auc", F.col("roc_auc") >= gates.min_roc_auc),
        gate("PRECISION", "precision", F.col("precision") >= gates.min_precision),
        gate("RECALL", "recall", F.col("recall") >= gates.min_recall),
        gate("F1", "f1", F.col("f1") >= gates.min_f1),
        gate("BRIER SCORE", "brier_score", F.col("brier_score") <= gates.max_brier),
    )


def drift_gate(drift: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Largest PSI and the number of drifting features; drift asks for review.

    Excluded features (such as the year itself) are listed, not judged. The drift
    table has one row per feature.
    """
    psi, excluded = F.col("psi"), F.col("feature").isin(*exclude) if exclude else F.lit(False)
    facts = drift.agg(
        F.max(F.when(~excluded, psi)).alias("top"),
        F.count_if(~excluded & (psi >= PSI_SIGNIFICANT)).alias("significant"),
        F.count_if(~excluded & (psi >= PSI_MODERATE) & (psi < PSI_SIGNIFICANT)).alias("moderate"),
        F.count_if(~excluded & (psi.isNull() | (psi < 0))).alias("unusable"),
        F.count_if(~excluded).alias("monitored"),
        F.concat_ws(", ", F.sort_array(F.collect_set(F.when(excluded, F.col("feature"))))).alias("left_out"),
    )
    rows = [
        _row("DRIFT", "PSI VALUES", _when(F.col("unusable") == 0), F.concat(F.lit("monitored_features="), F.col("monitored"))),
        _row("DRIFT", "MAXIMUM PSI", _when(F.col("top") < PSI_SIGNIFICANT, REVIEW), F.coalesce(_fixed(F.col("top")), F.lit(""))),
        _row("DRIFT", "SIGNIFICANT DRIFT FEATURES", _when(F.col("significant") == 0, REVIEW), F.col("significant")),
        _row(
            "DRIFT", "MODERATE DRIFT FEATURES", _when(F.col("moderate") == 0, REVIEW) if exclude else F.lit(PASS),
            F.col("moderate"),
        ),
    ]
    if exclude:
        rows.append(_row("DRIFT", "TEMPORAL FEATURE SHIFT", _when(F.col("left_out") == "", REVIEW), "", F.col("left_out")))
    return _rows(facts, *rows)


def repair_checks(
    df: DataFrame, expected_rows: Column | int, entity: str, year: str = "year", month: str = "month", column: str = "season",
    calendar: SeasonCalendar = CALENDAR_B,
) -> DataFrame:
    """Checks on a table whose months and seasons were repaired."""
    section = "REPAIR"
    m, s = F.col(month), F.col(column)
    expected = expected_rows if isinstance(expected_rows, Column) else F.lit(expected_rows)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~valid_month(m)).alias("bad_months"),
        F.count_if(s == UNKNOWN).alias("unknown"),
        F.count_if(s.isNotNull() & ~s.isin(*SEASONS)).alias("outside"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(s.isin(*SEASONS), s)))).alias("seasons"),
        F.count_if(~s.eqNullSafe(season(m, calendar))).alias("inconsistent"),
        F.count_if(F.col(entity).isNull()).alias("no_entity"),
        F.count_if(F.col(year).isNull()).alias("no_year"),
    )
    both = with_row(facts, duplicate_counts(df, [entity, year, month]), {"surplus": "surplus_rows"})
    zero = lambda c: _when(F.col(c) == 0)
    return _rows(
        both.withColumn("expected", expected),
        _row(section, "ROW_COUNT", _when(F.col("rows") == F.col("expected")), F.col("rows")),
        _row(section, "MONTH_RANGE", zero("bad_months"), F.col("bad_months")),
        _row(section, "UNKNOWN_SEASON", zero("unknown"), F.col("unknown")),
        _row(section, "SEASON_DOMAIN", zero("outside"), F.col("seasons")),
        _row(section, "MONTH_SEASON_CONSISTENCY", zero("inconsistent"), F.col("inconsistent")),
        _row(section, "ENTITY_NULL", zero("no_entity"), F.col("no_entity")),
        _row(section, "YEAR_NULL", zero("no_year"), F.col("no_year")),
        _row(section, "ENTITY_YEAR_MONTH_DUPLICATES", _when(F.col("surplus") == 0, REVIEW), F.col("surplus")),
    )


def dataset_checks(df: DataFrame, target: str, required: Sequence[str], leakage: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """Checks on a training table: schema, leakage, target, duplicates, months, seasons, types."""
    section = "DATASET"
    absent = sorted({*required, target} - set(df.columns))
    leaking = sorted(set(leakage) & set(df.columns))
    y = F.col(target).try_cast("double")
    present = [c for c in numeric if c in df.columns]
    not_numeric = F.lit(0)
    for c in present:
        not_numeric = not_numeric + flag(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
    m = normalize_month(F.col("month"))
    facts = df.agg(
        F.count_if(y.isNull()).alias("no_target"),
        F.count_if(y == 0).alias("zeros"), F.count_if(y == 1).alias("ones"),
        F.count_if(y.isNotNull() & ~y.isin(0.0, 1.0)).alias("other"),
        F.avg(y).alias("target_rate"),
        F.count_if(m.isNull()).alias("bad_months"),
        F.count_if(F.upper(F.trim(F.col("season"))) != season(m, CALENDAR_B)).alias("wrong_season"),
        F.sum(not_numeric).alias("not_numeric"),
    )
    both = with_row(facts, duplicate_counts(df, df.columns), {"surplus": "surplus_rows"})
    binary = (F.col("no_target") == 0) & (F.col("other") == 0) & (F.col("zeros") > 0) & (F.col("ones") > 0)
    return _rows(
        both,
        _row(section, "REQUIRED SCHEMA", F.lit(FAIL if absent else PASS), "", ", ".join(absent)),
        _row(section, "LEGACY LEAKAGE", F.lit(FAIL if leaking else PASS), "", ", ".join(leaking)),
        _row(section, "TARGET VALUES", _when(binary), F.concat(F.lit("rate="), _fixed(F.col("target_rate")))),
        _row(section, "EXACT DUPLICATES", _when(F.col("surplus") == 0), F.col("surplus")),
        _row(section, "MONTH VALIDATION", _when(F.col("bad_months") == 0), F.concat(F.lit("invalid="), F.col("bad_months"))),
        _row(section, "SEASON VALIDATION", F.lit(PASS), F.concat(F.lit("inconsistencies_repaired="), F.col("wrong_season"))),
        _row(section, "NUMERIC FEATURE TYPES", _when(F.col("not_numeric") == 0), F.col("not_numeric")),
    )


def calibration_checks(df: DataFrame, actual: str, probabilities: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Checks on calibrated scores: schema, ranges and the target."""
    section = "CALIBRATION"
    absent = sorted(set(required) - set(df.columns))
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(actual).isNotNull() & ~F.col(actual).isin(0, 1)).alias("other"),
        *[F.count_if(~valid_probability(F.col(p))).alias(f"bad_{p}") for p in probabilities],
    )
    ranges = [
        _row(section, f"{p} RANGE", _when(F.col(f"bad_{p}") == 0), F.concat(F.lit("invalid="), F.col(f"bad_{p}")))
        for p in probabilities
    ]
    return _rows(
        facts,
        _row(section, "OUTPUT SCHEMA", F.lit(FAIL if absent else PASS), "", ", ".join(absent)),
        *ranges,
        _row(section, "ACTUAL TARGET", _when(F.col("other") == 0), F.concat(F.lit("rows="), F.col("rows"))),
    )


def policy_table_checks(policy: DataFrame, metrics: DataFrame, predictions: DataFrame) -> DataFrame:
    """Checks on the selected policy and the tables made with it."""
    section = "POLICY"
    facts = policy.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~valid_probability(F.col("threshold"))).alias("bad"))
    facts = with_row(facts, metrics.agg(F.count(F.lit(1)).alias("n")), {"metric_rows": "n"})
    facts = with_row(facts, predictions.agg(F.count(F.lit(1)).alias("n")), {"prediction_rows": "n"})
    count = lambda c: F.concat(F.lit("rows="), F.col(c))
    return _rows(
        facts,
        _row(section, "SELECTED POLICY LOAD", _when(F.col("rows") > 0), count("rows")),
        _row(section, "THRESHOLD RANGE", _when(F.col("bad") == 0), F.col("bad")),
        _row(section, "POLICY PREDICTIONS", _when(F.col("prediction_rows") > 0), count("prediction_rows")),
        _row(section, "POLICY METRICS", _when(F.col("metric_rows") > 0), count("metric_rows")),
    )


def cross_step_checks(calibration: DataFrame, policy: DataFrame, year: str = "year") -> DataFrame:
    """Calibration rows and years, and the policy threshold's range."""
    facts = calibration.agg(F.count(F.lit(1)).alias("rows"), F.min(year).alias("lo"), F.max(year).alias("hi"))
    both = with_row(facts, policy.agg(F.min("threshold").alias("t")), {"t": "t"})
    span = F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))
    status = F.when(F.col("t").isNull(), REVIEW).when(F.col("t").between(0, 1), PASS).otherwise(FAIL)
    return _rows(
        both,
        _row("CROSS STEP", "CALIBRATION OUTPUT", _when(F.col("rows") > 0), F.concat(F.lit("rows="), F.col("rows")), span),
        _row("CROSS STEP", "POLICY THRESHOLD", status, F.coalesce(_fixed(F.col("t")), F.lit(""))),
    )


def contract_checks(df: DataFrame, required: Sequence[str], measure: str, key: Sequence[str]) -> DataFrame:
    """The documented contract: required fields filled, measure not negative, key unique."""
    section = "CONTRACT"
    facts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
        F.count_if(F.col(measure) < 0).alias("negative"),
    )
    both = with_row(facts, duplicate_counts(df, key), {"repeated": "repeated_keys"})
    return _rows(
        both,
        *[_row(section, f"{c} NOT NULL", _when(F.col(f"null_{c}") == 0), F.col(f"null_{c}")) for c in required],
        _row(section, f"{measure} NOT NEGATIVE", _when(F.col("negative") == 0), F.col("negative")),
        _row(section, "UNIQUE KEY", _when(F.col("repeated") == 0), F.col("repeated"), ", ".join(key)),
    )


def check_rollup(checks: DataFrame) -> DataFrame:
    """Number of checks per section and status."""
    return checks.groupBy("section", "status").agg(F.count(F.lit(1)).alias("checks"))


def release_decision(checks: DataFrame, with_review: str = "CONDITIONAL_GO") -> DataFrame:
    """Any failure stops the release, any review makes it conditional."""
    table = checks.agg(
        F.count_if(F.col("status") == PASS).alias("passes"),
        F.count_if(F.col("status") == FAIL).alias("failures"),
        F.count_if(F.col("status") == REVIEW).alias("reviews"),
    )
    decision = F.when(F.col("failures") > 0, "NO_GO").when(F.col("reviews") > 0, with_review).otherwise("GO")
    return table.withColumn("decision", decision)
