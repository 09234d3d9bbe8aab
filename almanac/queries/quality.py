"""Drift, monitoring decisions, data-quality checks and the release gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.calendar import CALENDAR_A, CALENDAR_B, fix_zero_based_months, season
from almanac.operators import checks, clean, drift, slices
from almanac.operators.clean import LEAKAGE_COLUMNS
from almanac.operators.joins import lookup_left, unexpected_values, union_all
from almanac.operators.policy import select_two_tier
from almanac.operators.ranking import arg_max
from almanac.operators.sweep import GRID_V4, threshold_sweep
from almanac.plans import monitoring
from almanac.plans import panel as plans
from almanac.plans.monitoring import POLICY_THRESHOLD
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.queries.scored import _RECENT
from almanac.session import stored
from almanac.sources.adapters import order_panel, quantity_panel, scored_lines, table
from almanac.spec import ScoreSpec

SCORE = ScoreSpec()
T = POLICY_THRESHOLD
NUMERIC = plans.NUMERIC_FEATURES
CATEGORICAL = ["entity", "month", "season"]

# Panel features up to 1999 against those from 2000 on; the z-score is emptied
# for two brands so that missing rates differ.
_ROWS = """d AS (SELECT * REPLACE (CASE WHEN entity IN ('Brand#11', 'Brand#12') AND year >= 2000 THEN NULL ELSE zscore END AS zscore),
  CASE WHEN year <= 1999 THEN 'REFERENCE' ELSE 'PRODUCTION' END AS period FROM temporal)"""
_BASE = [sql.P, *sql.risk("p"), sql.TARGETS, sql.TEMPORAL, _ROWS]
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT period, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM d" for c in NUMERIC) + ")"


def _drift_rows(spark, directory):
    rows = plans.temporal_features(plans.severe_dataset(quantity_panel(spark, directory)))
    masked = F.col("entity").isin("Brand#11", "Brand#12") & (F.col("year") >= 2000)
    labelled = drift.label_periods(rows.withColumn("zscore", F.when(~masked, F.col("zscore"))), "year", 1999, 2000)
    # Quantiles, bins and missing rates each pass over the rows.
    return stored(labelled.select("period", *NUMERIC, "entity", "month", "season", "condition"), "features")


def _psi(name: str, counts: str, keys: str) -> list[str]:
    """PSI per feature from (feature, bin) counts r and c."""
    return [
        f"{name}_s AS (SELECT *, greatest(CAST(r AS DOUBLE) / nullif(sum(r) OVER (PARTITION BY feature), 0), CAST(1e-6 AS DOUBLE)) AS rs, "
        f"greatest(CAST(c AS DOUBLE) / nullif(sum(c) OVER (PARTITION BY feature), 0), CAST(1e-6 AS DOUBLE)) AS cs FROM {counts})",
        f"{name} AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi, sum(r) AS rn, sum(c) AS cn{keys} FROM {name}_s GROUP BY feature)",
    ]


def _binned(name: str, edges_from: str, compare: str) -> list[str]:
    """Counts per feature and number of inner edges below the value."""
    return [
        *sql.quantile_edges("l", f"{name}_q", "value", "feature", where=edges_from),
        f"{name}_u AS (SELECT DISTINCT feature, edge FROM {name}_q)",
        f"{name}_n AS (SELECT feature, count(*) AS edges, min(edge) AS lo, max(edge) AS hi FROM {name}_u GROUP BY feature)",
        f"{name}_i AS (SELECT u.feature, edge FROM {name}_u u JOIN {name}_n n ON u.feature = n.feature WHERE edge > lo AND edge < hi "
        f"UNION ALL SELECT feature, lo - CAST(1e-6 AS DOUBLE) FROM {name}_n WHERE edges = 1 UNION ALL SELECT feature, lo + CAST(1e-6 AS DOUBLE) FROM {name}_n WHERE edges = 1)",
        f"{name}_v AS (SELECT feature, period, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)",
        f"{name}_b AS (SELECT v.feature, v.period, v.value, v.n, count(edge) AS bin FROM {name}_v v LEFT JOIN {name}_i i ON i.feature = v.feature AND edge {compare} value GROUP BY ALL)",
        f"{name}_c AS (SELECT feature, bin, coalesce(sum(n) FILTER (WHERE period = 'REFERENCE'), 0) AS r, coalesce(sum(n) FILTER (WHERE period = 'PRODUCTION'), 0) AS c FROM {name}_b GROUP BY feature, bin)",
    ]


_REFERENCE = [
    *_binned("k1", "AND period = 'REFERENCE'", "<"), *_psi("k1p", "k1_c", ""),
    "ref AS (SELECT k1p.feature, CASE WHEN rn < 20 OR cn < 20 THEN NULL WHEN edges < 3 THEN 0 ELSE psi END AS psi FROM k1p JOIN k1_n USING (feature))",
]
_POOLED = [
    *_binned("k2", "", "<="), *_psi("k2p", "k2_c", ""),
    "pool AS (SELECT feature, CASE WHEN rn > 0 AND cn > 0 THEN psi END AS psi FROM k2p)",
]
_CATEGORIES = [
    "cl AS (" + " UNION ALL ".join(f"SELECT period, '{c}' AS feature, {c} AS category FROM d" for c in CATEGORICAL) + ")",
    "cc AS (SELECT feature, category, count(*) FILTER (WHERE period = 'REFERENCE') AS r, count(*) FILTER (WHERE period = 'PRODUCTION') AS c FROM cl GROUP BY ALL)",
    *_psi("cat", "cc", ""),
]


@query("psi_reference_edges", final([*_BASE, _LONG, *_REFERENCE], "ref", "feature", "", "psi"))
def _psi_reference(spark, directory):
    return drift.psi_reference_edges(_drift_rows(spark, directory), NUMERIC)


@query("psi_pooled_edges", final([*_BASE, _LONG, *_POOLED], "pool", "feature", "", "psi"))
def _psi_pooled(spark, directory):
    return drift.psi_pooled_edges(_drift_rows(spark, directory), NUMERIC)


@query("psi_categorical", final([*_BASE, *_CATEGORIES], "cat", "feature", "", "psi"))
def _psi_categorical(spark, directory):
    return drift.psi_categorical(_drift_rows(spark, directory), CATEGORICAL)


_DRIFT = [
    *_BASE, _LONG, *_POOLED, *_CATEGORIES,
    "ml AS (SELECT feature, period, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS m FROM l UNION ALL SELECT feature, period, CASE WHEN category IS NULL THEN 1 ELSE 0 END FROM cl)",
    """mm AS (SELECT feature, count(*) FILTER (WHERE period = 'REFERENCE') AS reference_rows, count(*) FILTER (WHERE period = 'PRODUCTION') AS production_rows,
  avg(m) FILTER (WHERE period = 'REFERENCE') AS reference_missing_rate, avg(m) FILTER (WHERE period = 'PRODUCTION') AS production_missing_rate FROM ml GROUP BY feature)""",
    "pp AS (SELECT feature, psi, 'numeric' AS feature_type FROM pool UNION ALL SELECT feature, psi, 'categorical' FROM cat)",
    """fd AS (SELECT pp.*, reference_rows, production_rows, reference_missing_rate, production_missing_rate,
  production_missing_rate - reference_missing_rate AS missing_rate_change,
  CASE WHEN psi IS NULL THEN 'UNKNOWN' WHEN psi >= 0.25 THEN 'SIGNIFICANT' WHEN psi >= 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS drift_status,
  row_number() OVER (ORDER BY round(psi, 9) DESC NULLS LAST, feature) AS rank FROM pp JOIN mm USING (feature))""",
]


def _feature_drift(spark, directory):
    return drift.feature_drift(_drift_rows(spark, directory), NUMERIC, CATEGORICAL)


@query(
    "feature_drift",
    final(_DRIFT, "fd", "feature feature_type drift_status", "reference_rows production_rows rank",
          "psi reference_missing_rate production_missing_rate missing_rate_change"),
)
def _feature_drift_query(spark, directory):
    return _feature_drift(spark, directory)


@query(
    "feature_drift_moments",
    final(
        [*_BASE, _LONG, *_REFERENCE,
         """mo AS (SELECT feature, avg(value) FILTER (WHERE period = 'REFERENCE') AS reference_mean, avg(value) FILTER (WHERE period = 'PRODUCTION') AS current_mean,
  stddev_samp(value) FILTER (WHERE period = 'REFERENCE') AS reference_std, stddev_samp(value) FILTER (WHERE period = 'PRODUCTION') AS current_std,
  avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) FILTER (WHERE period = 'REFERENCE') AS reference_missing_rate,
  avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) FILTER (WHERE period = 'PRODUCTION') AS current_missing_rate FROM l GROUP BY feature)""",
         """mc AS (SELECT mo.*, psi, current_mean - reference_mean AS mean_change, (current_mean - reference_mean) / (abs(reference_mean) + CAST(1e-9 AS DOUBLE)) AS mean_change_pct,
  CASE WHEN psi IS NULL THEN 'UNAVAILABLE' WHEN psi >= 0.25 THEN 'SIGNIFICANT_DRIFT' WHEN psi >= 0.1 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS psi_status
  FROM mo JOIN ref USING (feature))"""],
        "mc", "feature psi_status", "",
        "reference_mean current_mean reference_std current_std reference_missing_rate current_missing_rate mean_change mean_change_pct psi",
    ).replace('"mean_change_pct"', "CASE WHEN abs(reference_mean) > 1e-6 THEN mean_change_pct END", 1),
)
def _moments(spark, directory):
    """The relative change of a mean that is zero up to rounding is not compared."""
    moments = drift.feature_drift_moments(_drift_rows(spark, directory), NUMERIC)
    usable = F.abs("reference_mean") > 1e-6
    return moments.withColumn("mean_change_pct", F.when(usable, F.col("mean_change_pct")))


@query(
    "drift_summary",
    final(
        [*_DRIFT, """ds AS (SELECT count(*) AS feature_count, count(*) FILTER (WHERE drift_status = 'STABLE') AS stable,
  count(*) FILTER (WHERE drift_status = 'MODERATE') AS moderate, count(*) FILTER (WHERE drift_status = 'SIGNIFICANT') AS significant,
  max(psi) AS maximum_psi, (SELECT feature FROM fd WHERE psi IS NOT NULL ORDER BY round(psi, 9) DESC, feature DESC LIMIT 1) AS maximum_psi_feature,
  CASE WHEN count(*) FILTER (WHERE drift_status = 'SIGNIFICANT') > 0 THEN 'REVIEW' ELSE 'PASS' END AS production_readiness FROM fd)"""],
        "ds", "maximum_psi_feature production_readiness", "feature_count stable moderate significant", "maximum_psi",
    ),
)
def _drift_summary(spark, directory):
    return drift.drift_summary(_feature_drift(spark, directory))


# K1 drift over the numeric features, the scored rows' metrics, and the change of
# the latest year, one row per monitor.
_MONITORS = [
    *_BASE, _LONG, *_REFERENCE, sql.S, *_RECENT, sql.confusion("s", "oc"), sql.rates("oc", "om"), sql.ranking("s", "orr"),
    "ch AS (SELECT max(event_rate) FILTER (WHERE period <> 'BASELINE') - max(event_rate) FILTER (WHERE period = 'BASELINE') AS e, "
    "max(alert_rate) FILTER (WHERE period <> 'BASELINE') - max(alert_rate) FILTER (WHERE period = 'BASELINE') AS a FROM rv)",
    """ps AS (SELECT max(psi) AS top, count(*) FILTER (WHERE psi >= 0.25) AS significant, count(*) FILTER (WHERE psi >= 0.1 AND psi < 0.25) AS moderate FROM ref)""",
    """mt AS (SELECT 'FEATURE_PSI' AS monitor, top AS value, CASE WHEN significant > 0 THEN 'SIGNIFICANT_DRIFT' WHEN moderate > 0 THEN 'MODERATE_DRIFT' ELSE 'STABLE' END AS status,
    significant || ' significant, ' || moderate || ' moderate' AS details FROM ps
  UNION ALL SELECT 'ALERT_RATE', alert_rate, CASE WHEN alert_rate > 0.3 THEN 'HIGH_ALERT_RATE' ELSE 'NORMAL' END, 'Threshold=0.09' FROM om
  UNION ALL SELECT 'F1', f1, CASE WHEN f1 < 0.15 THEN 'REVIEW' ELSE 'PASS' END, 'Policy performance' FROM om
  UNION ALL SELECT 'PR_AUC', pr_auc, CASE WHEN pr_auc < 0.1 THEN 'REVIEW' ELSE 'PASS' END, 'Ranking performance' FROM orr
  UNION ALL SELECT 'EVENT_RATE_CHANGE', e, CASE WHEN abs(e) > 0.03 THEN 'REVIEW' ELSE 'STABLE' END, 'Recent minus baseline' FROM ch
  UNION ALL SELECT 'ALERT_RATE_CHANGE', a, CASE WHEN abs(a) > 0.1 THEN 'REVIEW' ELSE 'STABLE' END, 'Recent minus baseline' FROM ch)""",
]


def _monitors(spark, directory):
    scored = stored(scored_lines(spark, directory).select("year", "actual", "probability"), "scored")
    return monitoring.monitors(scored, _drift_rows(spark, directory), NUMERIC)


@query("monitor_table", final(_MONITORS, "mt", "monitor status details", "", "value"))
def _monitor_table(spark, directory):
    return _monitors(spark, directory)


@query(
    "monitoring_decision",
    final(
        [*_MONITORS, """mn AS (SELECT count(*) FILTER (WHERE status = 'SIGNIFICANT_DRIFT') AS significant_issues,
  count(*) FILTER (WHERE status IN ('REVIEW', 'HIGH_ALERT_RATE', 'MODERATE_DRIFT')) AS review_items FROM mt)""",
         """md AS (SELECT *, CASE WHEN significant_issues > 0 THEN 'RETRAIN_OR_INVESTIGATE' WHEN review_items > 0 THEN 'MONITOR_CLOSELY'
  ELSE 'STABLE_FOR_CONTINUED_MONITORING' END AS decision, 0.09 AS policy_threshold, CASE WHEN review_items > 0 THEN 'ATTENTION_REQUIRED' ELSE 'STABLE' END AS monitoring_status FROM mn)"""],
        "md", "decision monitoring_status", "significant_issues review_items", "policy_threshold",
    ),
)
def _monitoring_decision(spark, directory):
    return drift.monitoring_decision(_monitors(spark, directory), T)


_MISSING = ["measure", "zscore", "historical_mean", "condition"]


@query(
    "missing_rates",
    final(
        [*_BASE, "m AS (" + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing_rate FROM d" for c in _MISSING
        ) + ")"],
        "m", "column", "", "missing_rate",
    ),
)
def _missing_rates(spark, directory):
    return checks.missing_rates(_drift_rows(spark, directory).select(*_MISSING))


@query(
    "duplicate_keys",
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE n > 1) AS repeated_keys,
  CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows_in_repeated_keys, CAST(sum(n - 1) AS BIGINT) AS surplus_rows FROM k""",
)
def _duplicate_keys(spark, directory):
    return checks.duplicate_counts(table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_key_rows",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
)
def _duplicate_key_rows(spark, directory):
    lines = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return checks.duplicate_key_rows(lines, ["l_orderkey", "l_linenumber"])


@query(
    "domain_check",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderpriority IS NULL) AS null_rows,
  count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS outside_rows,
  (SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))) AS outside_values,
  CASE WHEN count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders""",
)
def _domain_check(spark, directory):
    return checks.domain_check(table(spark, directory, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    "offending_values",
    "SELECT o_orderpriority, count(*) AS rows FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority",
)
def _offending(spark, directory):
    return checks.offending_values(table(spark, directory, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("unexpected_values", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def _unexpected(spark, directory):
    return unexpected_values(table(spark, directory, "events"), "event_type", ["click", "view"])


@query(
    "worst_feature",
    final([*_DRIFT, "x AS (SELECT feature, psi FROM fd WHERE psi IS NOT NULL ORDER BY round(psi, 9) DESC, feature LIMIT 1)"], "x", "feature", "", "psi"),
)
def _worst_feature(spark, directory):
    drifted = _feature_drift(spark, directory)
    return arg_max(drifted.withColumn("psi", F.round("psi", 9)), "feature", "psi")


@query(
    "worst_missing",
    final([*_BASE, "m AS (SELECT 'zscore' AS worst_column, avg(CASE WHEN zscore IS NULL THEN 1 ELSE 0 END) AS maximum_rate FROM d)"], "m", "worst_column", "", "maximum_rate"),
)
def _worst_missing(spark, directory):
    return checks.worst_missing(_drift_rows(spark, directory).select("historical_mean", "zscore", "measure"))


@query(
    "monitor_columns",
    f"""WITH {sql.S} SELECT count(*) AS n, round(avg(probability_2), 6) + 0.0 AS mean_probability,
  count(*) FILTER (WHERE probability_2 >= CAST(0.09 AS DOUBLE)) AS alerts, count(*) FILTER (WHERE month = 12) AS invalid_months FROM s""",
)
def _monitor_columns(spark, directory):
    """The first probability column present is monitored; alerts are derived when absent."""
    scored = scored_lines(spark, directory).withColumnRenamed("probability_2", "sigmoid_probability").drop("probability")
    picked = clean.pick_probability(scored, ["final_probability", "sigmoid_probability", "probability_3"])
    alerted = clean.pick_alert(picked, ["risk_alert"], "monitor_probability", T)
    shifted = alerted.withColumn("month", F.col("month") % 12)
    invalid = clean.invalid_month_rows(shifted).agg(F.count(F.lit(1))).scalar()
    facts = alerted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("monitor_probability").alias("mean_probability"), F.sum("monitor_alert").alias("alerts")
    )
    return facts.withColumn("invalid_months", invalid)


@query(
    "lookup_join",
    """WITH k AS (SELECT l_orderkey, min((l_partkey, l_suppkey)) AS m FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus, m[1] AS l_partkey, m[2] AS l_suppkey FROM orders LEFT JOIN k ON o_orderkey = l_orderkey""",
)
def _lookup_join(spark, directory):
    orders = table(spark, directory, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, directory, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lookup_left(orders, lines, ["o_orderkey"], ["l_partkey", "l_suppkey"])


def _row(section: str, check: str, status: str, value: str, details: str = "''", source: str = "f") -> str:
    return f"SELECT '{section}' AS section, {check} AS \"check\", {status} AS status, CAST({value} AS VARCHAR) AS value, {details} AS details FROM {source}"


def _ok(condition: str, otherwise: str = "FAIL") -> str:
    return f"CASE WHEN {condition} THEN 'PASS' ELSE '{otherwise}' END"


# The deployed table carries the seasons of calendar A, which calendar B disputes
# in December.
_DEPLOYED = [
    sql.S,
    f"dep AS (SELECT *, {sql.season_case('month', 'A')} AS season_a, CASE WHEN probability >= CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS risk_alert FROM s)",
    """f AS (SELECT count(*) AS n, count(*) FILTER (WHERE season_a <> season) AS wrong, min(year) AS lo, max(year) AS hi, min(probability) AS plo, max(probability) AS phi,
  avg(risk_alert) AS alert_rate FROM dep)""",
    "kf AS (SELECT count(*) FILTER (WHERE n > 1) AS groups FROM (SELECT region, year, month, count(*) AS n FROM dep GROUP BY ALL))",
    sql.confusion("s", "pc"), sql.rates("pc", "pm"), sql.ranking("s", "pr"),
    "g AS (SELECT pm.*, pr_auc, roc_auc FROM pm CROSS JOIN pr)",
    "checks AS (" + " UNION ALL ".join([
        _row("KEY STRUCTURE", "'DEPLOYMENT NULL KEY ROWS'", "'PASS'", "'rate=0.000000'"),
        _row("KEY STRUCTURE", "'DEPLOYMENT UNIQUE KEY'", _ok("groups = 0"), "'groups=' || groups", source="kf"),
        _row("KEY STRUCTURE", "'DEPLOYMENT INVALID MONTH ROWS'", "'PASS'", "0"),
        _row("TEMPORAL", "'DEPLOYMENT YEAR VALIDITY'", "'PASS'", "0"),
        _row("TEMPORAL", "'DEPLOYMENT YEAR RANGE'", "'PASS'", "lo || '-' || hi"),
        _row("MONTH", "'INVALID MONTH COUNT'", "'PASS'", "0"),
        _row("MONTH", "'INVALID MONTH RATE'", "'PASS'", "'0.000000'"),
        _row("MONTH", "'INVALID MONTH VALUES'", "'PASS'", "''"),
        _row("MONTH", "'MONTH ZERO RECORDS'", "'PASS'", "0"),
        _row("SEASON", "'UNKNOWN SEASONS'", "'PASS'", "0"),
        _row("SEASON", "'SEASON DOMAIN'", "'PASS'", "0"),
        _row("SEASON", "'MONTH SEASON CONSISTENCY'", _ok("wrong = 0"), "wrong"),
        _row("MISSING VALUES", "'DEPLOYMENT MISSING VALUE RATE'", "'PASS'", "'0.000000'"),
        _row("PROBABILITY", "'PROBABILITY COLUMN'", "'PASS'", "'risk_probability'"),
        _row("PROBABILITY", "'PROBABILITY NULL'", "'PASS'", "0"),
        _row("PROBABILITY", "'PROBABILITY RANGE'", "'PASS'", "0"),
        _row("PROBABILITY", "'PROBABILITY MINIMUM'", "'PASS'", "printf('%.6f', plo)"),
        _row("PROBABILITY", "'PROBABILITY MAXIMUM'", "'PASS'", "printf('%.6f', phi)"),
        _row("POLICY", "'POLICY THRESHOLD'", "'PASS'", "'column=risk_probability'"),
        _row("POLICY", "'POLICY ALERT CONSISTENCY'", "'PASS'", "0"),
        _row("POLICY", "'ALERT RATE'", _ok("alert_rate BETWEEN 0.01 AND 0.5", "REVIEW"), "printf('%.6f', alert_rate)"),
        *[
            _row("PERFORMANCE", f"'{check}'", _ok(f"{c} {op} {limit}"), f"printf('%.6f', {c})", source="g")
            for check, c, op, limit in [
                ("PR-AUC", "pr_auc", ">=", "0.1"), ("ROC-AUC", "roc_auc", ">=", "0.7"), ("PRECISION", "precision", ">=", "0.1"),
                ("RECALL", "recall", ">=", "0.25"), ("F1", "f1", ">=", "0.15"), ("BRIER SCORE", "brier_score", "<=", "0.1"),
            ]
        ],
    ]) + ")",
]
_CHECK_COLUMNS = "section check status value details"


def _deployed(spark, directory):
    scored = scored_lines(spark, directory, CALENDAR_A).drop("probability_2", "probability_3")
    # Keys, columns, months and performance each pass over the rows.
    return stored(monitoring.deployment_table(scored), "deployed")


def _quality(spark, directory):
    return monitoring.quality_checks(_deployed(spark, directory), SCORE, ["region", "year", "month"])


@query("quality_checks", final(_DEPLOYED, "checks", _CHECK_COLUMNS))
def _quality_checks(spark, directory):
    return _quality(spark, directory)


@query(
    "check_rollup",
    final([*_DEPLOYED, "r AS (SELECT section, status, count(*) AS checks FROM checks GROUP BY ALL)"], "r", "section status", "checks"),
)
def _rollup(spark, directory):
    return checks.check_rollup(_quality(spark, directory))


_DECISION = """r AS (SELECT count(*) FILTER (WHERE status = 'PASS') AS passes, count(*) FILTER (WHERE status = 'FAIL') AS failures,
  count(*) FILTER (WHERE status = 'REVIEW') AS reviews FROM checks),
x AS (SELECT *, CASE WHEN failures > 0 THEN 'NO_GO' WHEN reviews > 0 THEN '{review}' ELSE 'GO' END AS decision FROM r)"""


@query("release_decision", final([*_DEPLOYED, _DECISION.format(review="CONDITIONAL_GO")], "x", "decision", "passes failures reviews"))
def _release(spark, directory):
    return checks.release_decision(_quality(spark, directory))


_TABLES_SQL = [
    sql.P, *sql.risk("p"), sql.TARGETS,
    "f AS (SELECT count(*) FILTER (WHERE target_3m_severe_anomaly = 1) AS p, count(*) FILTER (WHERE target_3m_severe_anomaly = 0) AS n FROM tgt)",
    "ld AS (SELECT sum(n - 1) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey))",
    "checks AS (" + " UNION ALL ".join([
        _row("DATASET INTEGRITY", "'TARGET COLUMN'", "'PASS'", "''"),
        _row("DATASET INTEGRITY", "'TARGET BINARY VALIDATION'", "'PASS'", "'positive=' || p || ', negative=' || n"),
        _row("DATASET INTEGRITY", "'TARGET RATE'", "'PASS'", "printf('%.6f', CAST(p AS DOUBLE) / (p + n))"),
        _row("DATASET INTEGRITY", "'REQUIRED FEATURE SCHEMA'", "'FAIL'", "''", "'soil_moisture'"),
        _row("DATASET INTEGRITY", "'TARGET EXACT DUPLICATES'", "'PASS'", "0"),
        _row("DATASET INTEGRITY", "'LINES EXACT DUPLICATES'", _ok("surplus = 0", "REVIEW"), "surplus", source="ld").replace("CAST(surplus", "CAST(CAST(surplus AS BIGINT)"),
    ]) + ")",
]


@query("integrity_checks", final(_TABLES_SQL, "checks", _CHECK_COLUMNS))
def _integrity(spark, directory):
    target = plans.severe_dataset(quantity_panel(spark, directory)).select("entity", "year", "month", "zscore", plans.SEVERE_TARGET)
    lines = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return checks.integrity_checks(
        {"TARGET": target, "LINES": lines}, "TARGET", plans.SEVERE_TARGET, "TARGET", ["zscore", "soil_moisture"]
    )


@query(
    "drift_gate",
    final(
        [*_DRIFT, """f AS (SELECT max(psi) FILTER (WHERE feature <> 'year') AS top, count(*) FILTER (WHERE feature <> 'year' AND psi >= 0.25) AS significant,
  count(*) FILTER (WHERE feature <> 'year' AND psi >= 0.1 AND psi < 0.25) AS moderate, count(*) FILTER (WHERE feature <> 'year') AS monitored,
  count(*) FILTER (WHERE feature <> 'year' AND (psi IS NULL OR psi < 0)) AS unusable FROM fd)""",
         "checks AS (" + " UNION ALL ".join([
             _row("DRIFT", "'PSI VALUES'", _ok("unusable = 0"), "'monitored_features=' || monitored"),
             _row("DRIFT", "'MAXIMUM PSI'", _ok("top < 0.25", "REVIEW"), "printf('%.6f', top)"),
             _row("DRIFT", "'SIGNIFICANT DRIFT FEATURES'", _ok("significant = 0", "REVIEW"), "significant"),
             _row("DRIFT", "'MODERATE DRIFT FEATURES'", _ok("moderate = 0", "REVIEW"), "moderate"),
             _row("DRIFT", "'TEMPORAL FEATURE SHIFT'", "'REVIEW'", "''", "'year'"),
         ]) + ")"],
        "checks", _CHECK_COLUMNS,
    ),
)
def _drift_gate(spark, directory):
    return checks.drift_gate(_feature_drift(spark, directory), checks.DRIFT_EXCLUDED)


@query(
    "repair_checks",
    final(
        [sql.G, """f AS (SELECT count(*) AS n, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT """ + sql.season_case("month_no", "B") + """ AS s FROM g)) AS seasons FROM g)""",
         "checks AS (" + " UNION ALL ".join([
             _row("REPAIR", "'ROW_COUNT'", "'PASS'", "n"),
             _row("REPAIR", "'MONTH_RANGE'", "'PASS'", "0"), _row("REPAIR", "'UNKNOWN_SEASON'", "'PASS'", "0"),
             _row("REPAIR", "'SEASON_DOMAIN'", "'PASS'", "seasons"), _row("REPAIR", "'MONTH_SEASON_CONSISTENCY'", "'PASS'", "0"),
             _row("REPAIR", "'ENTITY_NULL'", "'PASS'", "0"), _row("REPAIR", "'YEAR_NULL'", "'PASS'", "0"),
             _row("REPAIR", "'ENTITY_YEAR_MONTH_DUPLICATES'", "'PASS'", "0"),
         ]) + ")"],
        "checks", _CHECK_COLUMNS,
    ),
)
def _repair_checks(spark, directory):
    damaged = order_panel(spark, directory).select("entity", "year", (F.col("month_no") - 1).alias("month"))
    fixed = fix_zero_based_months(damaged, "month").withColumn("season", season(F.col("month"), CALENDAR_B))
    expected = damaged.agg(F.count(F.lit(1))).scalar()
    return checks.repair_checks(fixed, expected, "entity")


_READINESS = [
    sql.P, *sql.risk("p"), sql.TARGETS, sql.S,
    f"df AS (SELECT avg(target_3m_severe_anomaly) AS rate, count(*) FILTER (WHERE {sql.season_case('month_no', 'A')} <> {sql.season_case('month_no', 'B')}) AS wrong FROM tgt)",
    "cf AS (SELECT count(*) AS n, min(year) AS lo, max(year) AS hi FROM s)",
    *sql.sweep("s", "w", 10, 500, 5),
    """pf AS (SELECT threshold FROM (SELECT * REPLACE (round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall) FROM w)
  ORDER BY CASE WHEN recall >= CAST(0.4 AS DOUBLE) AND precision >= CAST(0.1 AS DOUBLE) THEN 2 WHEN recall >= CAST(0.4 AS DOUBLE) THEN 1 ELSE 0 END DESC,
    f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1)""",
    "checks AS (" + " UNION ALL ".join([
        _row("DATASET", "'REQUIRED SCHEMA'", "'PASS'", "''", source="df"), _row("DATASET", "'LEGACY LEAKAGE'", "'PASS'", "''", source="df"),
        _row("DATASET", "'TARGET VALUES'", "'PASS'", "'rate=' || printf('%.6f', rate)", source="df"),
        _row("DATASET", "'EXACT DUPLICATES'", "'PASS'", "0", source="df"), _row("DATASET", "'MONTH VALIDATION'", "'PASS'", "'invalid=0'", source="df"),
        _row("DATASET", "'SEASON VALIDATION'", "'PASS'", "'inconsistencies_repaired=' || wrong", source="df"),
        _row("DATASET", "'NUMERIC FEATURE TYPES'", "'PASS'", "0", source="df"),
        _row("CALIBRATION", "'OUTPUT SCHEMA'", "'PASS'", "''", source="cf"),
        _row("CALIBRATION", "'probability RANGE'", "'PASS'", "'invalid=0'", source="cf"),
        _row("CALIBRATION", "'probability_2 RANGE'", "'PASS'", "'invalid=0'", source="cf"),
        _row("CALIBRATION", "'ACTUAL TARGET'", "'PASS'", "'rows=' || n", source="cf"),
        _row("POLICY", "'SELECTED POLICY LOAD'", "'PASS'", "'rows=1'", source="cf"), _row("POLICY", "'THRESHOLD RANGE'", "'PASS'", "0", source="cf"),
        _row("POLICY", "'POLICY PREDICTIONS'", "'PASS'", "'rows=' || n", source="cf"), _row("POLICY", "'POLICY METRICS'", "'PASS'", "'rows=99'", source="cf"),
        _row("CROSS STEP", "'CALIBRATION OUTPUT'", "'PASS'", "'rows=' || n", "lo || '-' || hi", source="cf"),
        _row("CROSS STEP", "'POLICY THRESHOLD'", "'PASS'", "printf('%.6f', threshold)", source="pf"),
    ]) + ")",
]


def _readiness(spark, directory):
    dataset = stored(plans.dataset_v4(quantity_panel(spark, directory)), "dataset")
    # Checks of rows and of counts pass over these columns several times.
    scored = stored(scored_lines(spark, directory), "scored")
    sweep = threshold_sweep(scored, SCORE, GRID_V4).withColumns({c: F.round(c, 9) for c in ("f1", "precision", "recall")})
    policy = select_two_tier(sweep)
    return union_all(
        checks.dataset_checks(
            dataset, plans.SEVERE_TARGET, [*plans.BASE_FEATURES, *plans.TEMPORAL_FEATURES], LEAKAGE_COLUMNS, plans.NUMERIC_FEATURES
        ),
        checks.calibration_checks(scored, "actual", ["probability", "probability_2"], ["region", "year", "month", "season", "actual", "probability"]),
        checks.policy_table_checks(policy, sweep, scored),
        checks.cross_step_checks(scored, policy),
    )


@query("readiness_checks", final(_READINESS, "checks", _CHECK_COLUMNS))
def _readiness_checks(spark, directory):
    return _readiness(spark, directory)


@query("readiness_decision", final([*_READINESS, _DECISION.format(review="GO_WITH_REVIEW")], "x", "decision", "passes failures reviews"))
def _readiness_decision(spark, directory):
    return checks.release_decision(_readiness(spark, directory), "GO_WITH_REVIEW")


@query(
    "contract_checks",
    final(
        ["f AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(*) FILTER (WHERE c_mktsegment IS NULL) AS no_segment FROM customer)",
         "k AS (SELECT count(*) AS repeated FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1))",
         "checks AS (" + " UNION ALL ".join([
             _row("CONTRACT", "'c_custkey NOT NULL'", "'PASS'", "0"),
             _row("CONTRACT", "'c_mktsegment NOT NULL'", _ok("no_segment = 0"), "no_segment"),
             _row("CONTRACT", "'c_acctbal NOT NEGATIVE'", _ok("negative = 0"), "negative"),
             _row("CONTRACT", "'UNIQUE KEY'", _ok("repeated = 0"), "repeated", "'c_nationkey, c_mktsegment'", source="k"),
         ]) + ")"],
        "checks", _CHECK_COLUMNS,
    ),
)
def _contract(spark, directory):
    customers = table(spark, directory, "customer")
    return checks.contract_checks(customers, ["c_custkey", "c_mktsegment"], "c_acctbal", ["c_nationkey", "c_mktsegment"])


@query(
    "season_distribution_unknown",
    f"""WITH {sql.S}, x AS (SELECT CASE WHEN month = 12 THEN 'UNKNOWN' ELSE season END AS season, actual, probability FROM s)
SELECT season, count(*) AS observations, CAST(sum(actual) AS BIGINT) AS events, round(avg(probability), 6) + 0.0 AS average_probability FROM x GROUP BY season""",
)
def _season_unknown(spark, directory):
    """Month 12 read as code 0: its rows have no season and stay a slice of their own."""
    scored = scored_lines(spark, directory).withColumn("month", F.when(F.col("month") != 12, F.col("month")).otherwise(0))
    recovered = clean.recover_season(scored.drop("season"))
    summary = slices.slice_summary(recovered, SCORE, T, "season")
    return summary.select("season", "observations", "events", "average_probability")




# The deployed table with damage of every kind the checks look for, chosen by the keys.
_DAMAGE = {
    "region": "CASE WHEN l_orderkey % 50 <> 0 THEN region END",
    "year": "CASE WHEN l_orderkey % 97 = 0 THEN 3000 ELSE year END",
    "month": "CASE l_linenumber WHEN 7 THEN 0 WHEN 6 THEN 13 ELSE month END",
    "season": "CASE WHEN l_orderkey % 11 = 0 THEN 'UNKNOWN' WHEN l_orderkey % 13 = 0 THEN 'AUTUMN' ELSE season END",
    "risk_probability": "CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN CAST(1.5 AS DOUBLE) WHEN l_orderkey % 23 = 0 THEN CAST(-0.25 AS DOUBLE) ELSE probability END",
    "policy_threshold": "CASE WHEN l_orderkey % 29 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(0.09 AS DOUBLE) END",
    "risk_alert": "CASE WHEN probability >= CAST(0.09 AS DOUBLE) AND l_orderkey % 31 <> 0 THEN 1 ELSE 0 END",
}
_DAMAGED = [
    sql.S,
    "dm AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{c_sql} AS {c}" for c, c_sql in _DAMAGE.items()) + " FROM s)",
    f"""fx AS (SELECT *, CASE WHEN month BETWEEN 1 AND 12 THEN {sql.season_case('month', 'B')} ELSE 'UNKNOWN' END AS derived, month NOT BETWEEN 1 AND 12 AS bad_month,
  CASE WHEN risk_probability >= policy_threshold THEN 1 ELSE 0 END AS expected FROM dm)""",
    """f AS (SELECT count(*) AS n, count(*) FILTER (WHERE region IS NULL) AS no_key, count(*) FILTER (WHERE bad_month) AS bad_months, count(*) FILTER (WHERE month = 0) AS zeros,
  (SELECT string_agg(CAST(month AS VARCHAR), ', ' ORDER BY month) FROM (SELECT DISTINCT month FROM fx WHERE bad_month)) AS listed,
  count(*) FILTER (WHERE year > 2100) AS bad_years, count(*) FILTER (WHERE season = 'UNKNOWN') AS unknown,
  count(*) FILTER (WHERE season IN ('UNKNOWN', 'AUTUMN')) AS outside, count(*) FILTER (WHERE season <> derived) AS wrong,
  avg(CASE WHEN region IS NULL THEN 1 ELSE 0 END) AS m_region, avg(CASE WHEN risk_probability IS NULL THEN 1 ELSE 0 END) AS m_p,
  count(*) FILTER (WHERE risk_probability IS NULL) AS null_p, count(*) FILTER (WHERE risk_probability NOT BETWEEN 0 AND 1) AS outside_p, min(risk_probability) AS plo, max(risk_probability) AS phi,
  count(*) FILTER (WHERE policy_threshold > 1) AS bad_t, count(*) FILTER (WHERE risk_alert <> expected) AS wrong_alerts, avg(risk_alert) AS alert_rate FROM fx)""",
    "kf AS (SELECT count(*) FILTER (WHERE n > 1) AS groups FROM (SELECT l_orderkey, region, count(*) AS n FROM dm GROUP BY ALL))",
    "checks AS (" + " UNION ALL ".join([
        _row("KEY STRUCTURE", "'STRICT NULL KEY ROWS'", _ok("no_key = 0"), "'rate=' || printf('%.6f', CAST(no_key AS DOUBLE) / n)"),
        _row("KEY STRUCTURE", "'STRICT UNIQUE KEY'", _ok("groups = 0"), "'groups=' || groups", source="kf"),
        _row("KEY STRUCTURE", "'STRICT INVALID MONTH ROWS'", _ok("bad_months = 0"), "bad_months"),
        _row("KEY STRUCTURE", "'LOOSE NULL KEY ROWS'", _ok("no_key = 0", "REVIEW"), "'rate=' || printf('%.6f', CAST(no_key AS DOUBLE) / n)"),
        _row("KEY STRUCTURE", "'LOOSE UNIQUE KEY'", _ok("groups = 0", "REVIEW"), "'groups=' || groups", source="kf"),
        _row("KEY STRUCTURE", "'LOOSE INVALID MONTH ROWS'", _ok("bad_months = 0", "REVIEW"), "bad_months"),
        _row("TEMPORAL", "'DAMAGED YEAR VALIDITY'", _ok("bad_years = 0"), "bad_years"), _row("TEMPORAL", "'DAMAGED YEAR RANGE'", _ok("bad_years = 0"), "''"),
        _row("MONTH", "'INVALID MONTH COUNT'", _ok("bad_months = 0"), "bad_months"),
        _row("MONTH", "'INVALID MONTH RATE'", _ok("bad_months = 0"), "printf('%.6f', CAST(bad_months AS DOUBLE) / n)"),
        _row("MONTH", "'INVALID MONTH VALUES'", _ok("bad_months = 0"), "listed"), _row("MONTH", "'MONTH ZERO RECORDS'", _ok("zeros = 0"), "zeros"),
        _row("SEASON", "'UNKNOWN SEASONS'", _ok("unknown = 0"), "unknown"), _row("SEASON", "'SEASON DOMAIN'", _ok("outside = 0"), "outside"),
        _row("SEASON", "'MONTH SEASON CONSISTENCY'", _ok("wrong = 0"), "wrong"),
        _row("MISSING VALUES", "'DAMAGED MISSING VALUE RATE'", _ok("m_region = 0 AND m_p = 0", "REVIEW"), "printf('%.6f', greatest(m_region, m_p))", "CASE WHEN m_region >= m_p THEN 'region' ELSE 'risk_probability' END"),
        _row("PROBABILITY", "'PROBABILITY COLUMN'", "'PASS'", "'risk_probability'"), _row("PROBABILITY", "'PROBABILITY NULL'", _ok("null_p = 0"), "null_p"),
        _row("PROBABILITY", "'PROBABILITY RANGE'", _ok("outside_p = 0"), "outside_p"), _row("PROBABILITY", "'PROBABILITY MINIMUM'", "'PASS'", "printf('%.6f', plo)"),
        _row("PROBABILITY", "'PROBABILITY MAXIMUM'", "'PASS'", "printf('%.6f', phi)"),
        _row("POLICY", "'POLICY THRESHOLD'", _ok("bad_t = 0"), "'column=risk_probability'"), _row("POLICY", "'POLICY ALERT CONSISTENCY'", _ok("wrong_alerts = 0"), "wrong_alerts"),
        _row("POLICY", "'ALERT RATE'", _ok("alert_rate BETWEEN 0.01 AND 0.5", "REVIEW"), "printf('%.6f', alert_rate)"),
    ]) + ")",
]


@query("damaged_quality_checks", final(_DAMAGED, "checks", _CHECK_COLUMNS))
def _damaged_quality(spark, directory):
    """Every check on a table that gives it something to find."""
    scored = scored_lines(spark, directory).select("l_orderkey", "l_linenumber", *[F.expr(expression).alias(c) for c, expression in _DAMAGE.items()])
    damaged, keys = stored(scored, "damaged"), ["l_orderkey", "region"]
    return union_all(
        checks.key_checks("STRICT", damaged, keys, "month", strict=True),
        checks.key_checks("LOOSE", damaged, keys, "month", strict=False),
        checks.one_pass(
            damaged, checks.temporal_family("DAMAGED"), checks.month_family(damaged), checks.season_family(),
            checks.missing_family("DAMAGED", damaged.columns), checks.probability_family("risk_probability"),
            checks.policy_family("risk_probability", "policy_threshold", "risk_alert"),
        ),
    )


@query(
    "damaged_repair_checks",
    final(
        [sql.G,
         """d AS (SELECT CASE WHEN entity <> 'FRANCE' THEN entity END AS entity, CASE WHEN year <> 1995 THEN year END AS year, CASE WHEN month_no = 4 AND entity = 'CHINA' THEN 14 ELSE month_no END AS month,
  CASE WHEN entity = 'BRAZIL' THEN 'UNKNOWN' WHEN entity = 'EGYPT' THEN 'AUTUMN' WHEN entity = 'INDIA' THEN NULL ELSE """ + sql.season_case("month_no", "A") + """ END AS season FROM g)""",
         f"""f AS (SELECT count(*) AS n, (SELECT count(*) + 1 FROM g) AS expected, count(*) FILTER (WHERE month NOT BETWEEN 1 AND 12) AS bad, count(*) FILTER (WHERE season = 'UNKNOWN') AS unknown,
  count(*) FILTER (WHERE season = 'AUTUMN' OR season = 'UNKNOWN') AS outside, string_agg(DISTINCT season, ',' ORDER BY season) FILTER (WHERE season NOT IN ('AUTUMN', 'UNKNOWN')) AS seasons,
  count(*) FILTER (WHERE season IS DISTINCT FROM coalesce({sql.season_case('month', 'B')}, 'UNKNOWN')) AS wrong, count(*) FILTER (WHERE entity IS NULL) AS no_entity,
  count(*) FILTER (WHERE year IS NULL) AS no_year FROM d)""",
         "sp AS (SELECT sum(n - 1) AS surplus FROM (SELECT count(*) AS n FROM d GROUP BY entity, year, month))",
         "checks AS (" + " UNION ALL ".join([
             _row("REPAIR", "'ROW_COUNT'", _ok("n = expected"), "n"), _row("REPAIR", "'MONTH_RANGE'", _ok("bad = 0"), "bad"),
             _row("REPAIR", "'UNKNOWN_SEASON'", _ok("unknown = 0"), "unknown"), _row("REPAIR", "'SEASON_DOMAIN'", _ok("outside = 0"), "seasons"),
             _row("REPAIR", "'MONTH_SEASON_CONSISTENCY'", _ok("wrong = 0"), "wrong"), _row("REPAIR", "'ENTITY_NULL'", _ok("no_entity = 0"), "no_entity"),
             _row("REPAIR", "'YEAR_NULL'", _ok("no_year = 0"), "no_year"),
             _row("REPAIR", "'ENTITY_YEAR_MONTH_DUPLICATES'", _ok("surplus = 0", "REVIEW"), "CAST(surplus AS BIGINT)", source="sp"),
         ]) + ")"],
        "checks", _CHECK_COLUMNS,
    ),
)
def _damaged_repair(spark, directory):
    panel = order_panel(spark, directory)
    name = F.when(F.col("entity") == "BRAZIL", "UNKNOWN").when(F.col("entity") == "EGYPT", "AUTUMN").when(F.col("entity") != "INDIA", season(F.col("month_no"), CALENDAR_A))
    damaged = panel.select(
        F.when(F.col("entity") != "FRANCE", F.col("entity")).alias("entity"), F.when(F.col("year") != 1995, F.col("year")).alias("year"),
        F.when((F.col("month_no") == 4) & (F.col("entity") == "CHINA"), 14).otherwise(F.col("month_no")).alias("month"), name.alias("season"),
    )
    table_ = stored(damaged, "damaged")
    return checks.repair_checks(table_, table_.agg(F.count(F.lit(1)) + 1).scalar(), "entity")
