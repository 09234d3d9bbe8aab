"""Metrics, slices, ranks and top-k reports on scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.calendar import period_thirds
from almanac.functions.levels import alert, alert_level, confusion_label, deployment_level, inference_level, policy_level
from almanac.operators import metrics, ranking, slices
from almanac.operators.sweep import GRID_FINE, GRID_POLICY, GRID_SENSITIVITY, GridList, threshold_sweep
from almanac.plans.monitoring import POLICY_THRESHOLD, deployment_table
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.sources.adapters import scored_lines
from almanac.spec import ScoreSpec

SCORE = ScoreSpec()
T = POLICY_THRESHOLD

_ALERT_LEVEL = (
    "CASE WHEN probability < CAST(0.05 AS DOUBLE) THEN 'LOW' WHEN probability < CAST(0.10 AS DOUBLE) THEN 'MODERATE' "
    "WHEN probability < CAST(0.15 AS DOUBLE) THEN 'ELEVATED' WHEN probability < CAST(0.25 AS DOUBLE) THEN 'HIGH' ELSE 'CRITICAL' END"
)
_DEPLOYMENT_LEVEL = (
    "CASE WHEN probability >= CAST(0.15 AS DOUBLE) THEN 'CRITICAL' WHEN probability >= CAST(0.10 AS DOUBLE) THEN 'HIGH' "
    "WHEN probability >= CAST(0.09 AS DOUBLE) THEN 'ELEVATED' WHEN probability >= CAST(0.05 AS DOUBLE) THEN 'MODERATE' ELSE 'LOW' END"
)
_LABEL = (
    "CASE WHEN actual = 1 AND probability >= CAST(0.09 AS DOUBLE) THEN 'TRUE_POSITIVE' WHEN actual = 0 AND probability >= CAST(0.09 AS DOUBLE) THEN 'FALSE_POSITIVE' "
    "WHEN actual = 1 THEN 'FALSE_NEGATIVE' ELSE 'TRUE_NEGATIVE' END"
)


@query(
    "event_rate_by_level",
    final(
        [sql.S, f"e AS (SELECT {_ALERT_LEVEL} AS alert_level, count(actual) AS observations, sum(actual) AS events, avg(actual) AS event_rate FROM s GROUP BY 1)"],
        "e", "alert_level", "observations events", "event_rate",
    ),
)
def _event_rate(spark, directory):
    scored = scored_lines(spark, directory).withColumn("alert_level", alert_level(F.col("probability")))
    return slices.event_rate_by(scored, "alert_level", "actual")


@query(
    "risk_scales",
    final(
        [sql.S, f"""e AS (SELECT {_ALERT_LEVEL} AS alert_level, {_DEPLOYMENT_LEVEL} AS deployment_level,
  CASE WHEN probability >= CAST(0.2 AS DOUBLE) THEN 'HIGH' WHEN probability >= CAST(0.2 AS DOUBLE) * 0.75 THEN 'WATCH'
    WHEN probability >= CAST(0.2 AS DOUBLE) * 0.5 THEN 'LOW' ELSE 'NORMAL' END AS policy_level,
  CASE WHEN probability >= CAST(0.2 AS DOUBLE) * 2 THEN 'HIGH' WHEN probability >= CAST(0.2 AS DOUBLE) THEN 'ALERT'
    WHEN probability >= CAST(0.2 AS DOUBLE) * 0.5 THEN 'WATCH' ELSE 'NORMAL' END AS inference_level,
  {_LABEL} AS error_type, count(*) AS n FROM s GROUP BY ALL)"""],
        "e", "alert_level deployment_level policy_level inference_level error_type", "n",
    ),
)
def _risk_scales(spark, directory):
    p, t = F.col("probability"), F.lit(0.2)
    named = scored_lines(spark, directory).select(
        alert_level(p).alias("alert_level"), deployment_level(p).alias("deployment_level"),
        policy_level(p, t).alias("policy_level"), inference_level(p, t).alias("inference_level"),
        confusion_label(F.col("actual"), alert(p, T)).alias("error_type"),
    )
    return named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "regional_alert_summary",
    final(
        [sql.S, """r AS (SELECT region, count(actual) AS observations, sum(actual) AS actual_events, avg(probability) AS average_probability,
  max(probability) AS maximum_probability, count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS alerts, avg(actual) AS actual_event_rate,
  CAST(count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / count(*) AS alert_rate FROM s GROUP BY region)"""],
        "r", "region", "observations actual_events alerts", "average_probability maximum_probability actual_event_rate alert_rate",
    ),
)
def _regional_alerts(spark, directory):
    return slices.regional_alert_summary(scored_lines(spark, directory), SCORE, T)


def _metrics_sql(by: str, ctes: list[str] | None = None, source: str = "s", text: bool = False) -> str:
    return final(
        [sql.S, *(ctes or []), sql.confusion(source, "c", by), sql.rates("c", "m")],
        "m", by if text else "", (sql.COUNT_COLUMNS if text or not by else f"{by} {sql.COUNT_COLUMNS}"), sql.METRIC_COLUMNS,
    )


@query("confusion_metrics", _metrics_sql(""))
def _confusion_metrics(spark, directory):
    return metrics.metrics_by(scored_lines(spark, directory), SCORE, T)


@query("metrics_by_season", _metrics_sql("season", text=True))
def _metrics_by_season(spark, directory):
    return metrics.metrics_by(scored_lines(spark, directory), SCORE, T, ["season"])


@query("metrics_by_region", _metrics_sql("region", text=True))
def _metrics_by_region(spark, directory):
    return metrics.metrics_by(scored_lines(spark, directory), SCORE, T, ["region"])


@query("metrics_by_year", _metrics_sql("year"))
def _metrics_by_year(spark, directory):
    return metrics.metrics_by(scored_lines(spark, directory), SCORE, T, ["year"])


@query("metrics_by_month", _metrics_sql("month"))
def _metrics_by_month(spark, directory):
    return metrics.metrics_by(scored_lines(spark, directory), SCORE, T, ["month"])


_PERIOD = """per AS (SELECT *, CASE WHEN year <= lo + CAST(hi - lo AS DOUBLE) / 3 THEN 'EARLY' WHEN year <= lo + 2 * CAST(hi - lo AS DOUBLE) / 3 THEN 'MIDDLE' ELSE 'LATE' END AS time_period
  FROM s CROSS JOIN (SELECT min(year) AS lo, max(year) AS hi FROM s))"""


@query("metrics_by_period", _metrics_sql("time_period", [_PERIOD], "per", True))
def _metrics_by_period(spark, directory):
    return slices.metrics_by_period(scored_lines(spark, directory), SCORE, T)


@query("average_precision", final([sql.S, sql.ranking("s", "r")], "r", "", "", "pr_auc"))
def _average_precision(spark, directory):
    return metrics.average_precision(scored_lines(spark, directory), SCORE)


@query("roc_auc", final([sql.S, sql.ranking("s", "r")], "r", "", "", "roc_auc"))
def _roc_auc(spark, directory):
    return metrics.roc_auc(scored_lines(spark, directory), SCORE)


@query("ranking_by_region_season", final([sql.S, sql.ranking("s", "r", "region, season")], "r", "region season", "", "pr_auc roc_auc"))
def _ranking_by(spark, directory):
    return metrics.ranking_metrics(scored_lines(spark, directory), SCORE, ["region", "season"])


@query(
    "brier",
    final([sql.S, "b AS (SELECT season, avg((probability - actual) * (probability - actual)) AS brier_score FROM s GROUP BY season)"], "b", "season", "", "brier_score"),
)
def _brier(spark, directory):
    return metrics.brier(scored_lines(spark, directory), SCORE, ["season"])


_SWEEP_COLUMNS = ("", sql.COUNT_COLUMNS, f"threshold {sql.RATE_COLUMNS}")


@query("threshold_sweep", final([sql.S, *sql.sweep("s", "w", 10, 500, 10)], "w", *_SWEEP_COLUMNS))
def _sweep(spark, directory):
    return threshold_sweep(scored_lines(spark, directory), SCORE, GRID_FINE)


@query("threshold_sweep_by_season", final([sql.S, *sql.sweep("s", "w", 10, 170, 5, "season")], "w", "season", *_SWEEP_COLUMNS[1:]))
def _sweep_by_season(spark, directory):
    return threshold_sweep(scored_lines(spark, directory), SCORE, GRID_POLICY, ["season"])


@query("threshold_list", final([sql.S, *sql.sweep("s", "w", 50, 150, 10)], "w", *_SWEEP_COLUMNS))
def _threshold_list(spark, directory):
    grid = GridList(tuple(k / 1000 for k in range(50, 151, 10)))
    return threshold_sweep(scored_lines(spark, directory), SCORE, grid)


@query(
    "reliability_deciles",
    final(
        [sql.S, *sql.quantile_edges("s", "q", "probability"), "d AS (SELECT DISTINCT edge FROM q)",
         "k AS (SELECT probability, greatest(count(edge), 1) AS bin FROM (SELECT DISTINCT probability FROM s) LEFT JOIN d ON edge < probability GROUP BY 1)",
         "b AS (SELECT bin, actual, probability FROM s JOIN k USING (probability))",
         """r AS (SELECT bin, count(*) AS observations, sum(actual) AS events, avg(probability) AS mean_probability, min(probability) AS minimum_probability,
  max(probability) AS maximum_probability, avg(actual) AS actual_event_rate FROM b GROUP BY bin)"""],
        "r", "", "bin observations events", "mean_probability minimum_probability maximum_probability actual_event_rate",
    ),
)
def _reliability(spark, directory):
    return slices.reliability(scored_lines(spark, directory), SCORE)


@query(
    "probability_bands",
    final(
        [sql.S, """b AS (SELECT CASE WHEN probability < CAST(0.02 AS DOUBLE) THEN 'VERY_LOW_<2%' WHEN probability < CAST(0.05 AS DOUBLE) THEN 'LOW_2-5%'
  WHEN probability < CAST(0.10 AS DOUBLE) THEN 'MODERATE_5-10%' WHEN probability < CAST(0.15 AS DOUBLE) THEN 'ELEVATED_10-15%'
  WHEN probability < CAST(0.20 AS DOUBLE) THEN 'HIGH_15-20%' ELSE 'CRITICAL_>=20%' END AS probability_band,
  count(*) AS observations, sum(actual) AS events, avg(actual) AS actual_event_rate, avg(probability) AS mean_predicted_probability,
  abs(avg(actual) - avg(probability)) AS calibration_gap FROM s GROUP BY 1)"""],
        "b", "probability_band", "observations events", "actual_event_rate mean_predicted_probability calibration_gap",
    ),
)
def _bands(spark, directory):
    return slices.probability_bands(scored_lines(spark, directory), SCORE)


_EDGES = ["0.00", "0.02", "0.04", "0.06", "0.08", "0.09", "0.10", "0.12", "0.15", "0.20", "0.30", "0.50", "0.70", "1.01"]
_BINS = "e AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{lo}+', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" if hi == "1.01" else f"('{lo}-{hi}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))"
    for lo, hi in zip(_EDGES, _EDGES[1:])
) + ") AS v(probability_bin, lo, hi))"


@query(
    "probability_bins",
    final(
        [sql.S, "u AS (SELECT *, probability / 2 AS halved FROM s)", _BINS,
         """b AS (SELECT probability_bin, count(halved) AS observations, coalesce(sum(actual), 0) AS events, avg(actual) AS actual_event_rate,
  count(*) FILTER (WHERE halved >= CAST(0.09 AS DOUBLE)) AS alerts,
  CAST(count(*) FILTER (WHERE halved >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / nullif(count(halved), 0) AS alert_rate, avg(halved) AS average_probability,
  count(*) FILTER (WHERE actual = 0 AND halved >= CAST(0.09 AS DOUBLE)) AS false_positives,
  count(*) FILTER (WHERE actual = 1 AND halved < CAST(0.09 AS DOUBLE)) AS false_negatives
  FROM e LEFT JOIN u ON halved >= lo AND halved < hi GROUP BY probability_bin)"""],
        "b", "probability_bin", "observations events alerts false_positives false_negatives", "actual_event_rate alert_rate average_probability",
    ),
)
def _bins(spark, directory):
    """Halved probabilities stay below 0.5, so two bins are empty and must be kept."""
    scored = scored_lines(spark, directory).withColumn("halved", F.col("probability") / 2)
    return slices.probability_bins(scored, ScoreSpec(probability="halved"), T)


@query(
    "error_composition",
    final(
        [sql.S, f"c AS (SELECT {_LABEL} AS error_type, count(*) AS count, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS percentage FROM s GROUP BY 1)"],
        "c", "error_type", "count", "percentage",
    ),
)
def _composition(spark, directory):
    scored = scored_lines(spark, directory).withColumn("error_type", confusion_label(F.col("actual"), alert(F.col("probability"), T)))
    return ranking.composition(scored, "error_type")


@query(
    "risk_distribution",
    final(
        [sql.S, f"""d AS (SELECT {_DEPLOYMENT_LEVEL} AS risk_level, count(*) AS observations, sum(actual) AS events, avg(actual) AS event_rate,
  avg(probability) AS average_probability, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS percentage FROM s GROUP BY 1)""",
         "o AS (SELECT *, list_position(['LOW', 'MODERATE', 'ELEVATED', 'HIGH', 'CRITICAL'], risk_level) AS level_order FROM d)"],
        "o", "risk_level", "observations events level_order", "event_rate average_probability percentage",
    ),
)
def _distribution(spark, directory):
    return slices.risk_distribution(scored_lines(spark, directory), SCORE)


_QUANTILES = {"median": "0.5", "p25": "0.25", "p75": "0.75", "p90": "0.9", "p95": "0.95", "p99": "0.99"}


@query(
    "probability_summary",
    final(
        [sql.S, """q AS (SELECT count(*) AS observations, avg(probability) AS mean_probability, stddev_samp(probability) AS std_probability,
  min(probability) AS minimum_probability, max(probability) AS maximum_probability, CAST(0.09 AS DOUBLE) AS policy_threshold,
  count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS alerts,
  CAST(count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / count(*) AS alert_rate, """
         + ", ".join(f"quantile_cont(probability, {q}) AS {n}_probability" for n, q in _QUANTILES.items()) + " FROM s)"],
        "q", "", "observations alerts",
        "mean_probability std_probability minimum_probability maximum_probability policy_threshold alert_rate "
        + " ".join(f"{n}_probability" for n in _QUANTILES),
    ),
)
def _summary(spark, directory):
    return slices.probability_summary(scored_lines(spark, directory), SCORE, T)


@query(
    "alert_stability",
    final(
        [sql.S, """y AS (SELECT year, count(*) AS observations, count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS alerts,
  CAST(count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / count(*) AS alert_rate, avg(probability) AS mean_probability,
  quantile_cont(probability, 0.95) AS p95_probability, max(probability) AS maximum_probability FROM s GROUP BY year)"""],
        "y", "", "year observations alerts", "alert_rate mean_probability p95_probability maximum_probability",
    ),
)
def _stability(spark, directory):
    return slices.alert_stability(scored_lines(spark, directory), SCORE, T)


@query(
    "target_drift",
    final(
        [sql.S, "g AS (SELECT avg(actual) AS rate FROM s)",
         """y AS (SELECT year, count(*) AS observations, sum(actual) AS events, avg(actual) AS event_rate, avg(probability) AS mean_probability,
  CAST(count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / count(*) AS alert_rate FROM s GROUP BY year)""",
         "d AS (SELECT y.*, event_rate / (rate + CAST(1e-12 AS DOUBLE)) AS event_rate_vs_global, event_rate - rate AS absolute_event_rate_change FROM y CROSS JOIN g)"],
        "d", "", "year observations events", "event_rate mean_probability alert_rate event_rate_vs_global absolute_event_rate_change",
    ),
)
def _target_drift(spark, directory):
    return slices.target_drift(scored_lines(spark, directory), SCORE, T)


_RECENT = [
    "lp AS (SELECT *, CASE WHEN year = (SELECT max(year) FROM s) THEN 'RECENT_' || year ELSE 'BASELINE' END AS period FROM s)",
    sql.confusion("lp", "c", "period"), sql.rates("c", "m"), sql.ranking("lp", "r", "period"),
    "rv AS (SELECT m.*, average_probability AS mean_probability, pr_auc, roc_auc FROM m JOIN r USING (period))",
]


@query(
    "recent_vs_baseline",
    final(
        [sql.S, *_RECENT], "rv", "period", "observations",
        "event_rate mean_probability alert_rate precision recall f1 pr_auc roc_auc brier_score",
    ),
)
def _recent(spark, directory):
    return slices.recent_vs_baseline(scored_lines(spark, directory), SCORE, T)


@query(
    "compare_periods",
    final(
        [sql.S, *_RECENT[:1], """a AS (SELECT avg(actual) FILTER (WHERE period = 'BASELINE') AS baseline_event_rate, avg(actual) FILTER (WHERE period <> 'BASELINE') AS recent_event_rate,
  avg(probability) FILTER (WHERE period = 'BASELINE') AS baseline_probability, avg(probability) FILTER (WHERE period <> 'BASELINE') AS recent_probability FROM lp)""",
         "d AS (SELECT *, recent_event_rate - baseline_event_rate AS event_rate_change, recent_probability - baseline_probability AS probability_change FROM a)"],
        "d", "", "", "baseline_event_rate recent_event_rate baseline_probability recent_probability event_rate_change probability_change",
    ),
)
def _compare_periods(spark, directory):
    labelled = slices.label_recent(scored_lines(spark, directory))
    renamed = labelled.withColumn("period", F.when(F.col("period") == "BASELINE", "BASELINE").otherwise("RECENT"))
    return slices.compare_periods(renamed, "period", {"event_rate": "actual", "probability": "probability"}, "BASELINE", "RECENT")


@query(
    "unknown_month",
    final(
        [sql.S, """u AS (SELECT count(*) AS observations, coalesce(sum(actual), 0) AS events,
  count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS alerts, avg(probability) AS average_probability, max(probability) AS maximum_probability,
  coalesce(avg(actual), 0) AS event_rate,
  coalesce(CAST(count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS DOUBLE) / nullif(count(*), 0), 0) AS alert_rate
  FROM s WHERE month = 1)"""],
        "u", "", "observations events alerts", "average_probability maximum_probability event_rate alert_rate",
    ),
)
def _unknown_month(spark, directory):
    """Months coded 0..11 without repair: January reads as an invalid month."""
    scored = scored_lines(spark, directory).withColumn("month", F.col("month") - 1)
    return slices.unknown_month(scored, SCORE, T)


_SUMMARY_DOUBLES = "event_rate alert_rate average_probability maximum_probability precision recall f1"


@query(
    "regional_dense_rank",
    final(
        [sql.S, sql.confusion("s", "c", "l_suppkey"), sql.rates("c", "m"),
         "d AS (SELECT *, dense_rank() OVER (ORDER BY average_probability DESC) AS risk_rank FROM (SELECT * REPLACE (round(average_probability, 6) AS average_probability) FROM m))"],
        "d", "", "l_suppkey observations events alerts risk_rank", _SUMMARY_DOUBLES,
    ),
)
def _dense_rank(spark, directory):
    """Ranked by rounded probability: many suppliers share a rank at this precision."""
    table = slices.slice_summary(scored_lines(spark, directory), SCORE, T, "l_suppkey")
    # As SQL rounds a double: its product is rounded, not its shortest decimal form.
    rounded = table.withColumn("average_probability", F.round(F.col("average_probability") * 1e6) / 1e6)
    return ranking.dense_rank_by(rounded, "average_probability")


@query("slice_summary_month", final([sql.S, sql.confusion("s", "c", "month"), sql.rates("c", "m")], "m", "", "month observations events alerts", _SUMMARY_DOUBLES))
def _slice_summary(spark, directory):
    return slices.slice_summary(scored_lines(spark, directory), SCORE, T, "month")


@query(
    "monitored_regions",
    final(
        [sql.S, sql.confusion("s", "c", "region"), sql.rates("c", "m"), sql.ranking("s", "r", "region"),
         "x AS (SELECT m.*, pr_auc, roc_auc, CASE WHEN observations < 20 THEN 'SMALL_SAMPLE' ELSE '' END AS sample_warning FROM m JOIN r USING (region))"],
        "x", "region sample_warning", sql.COUNT_COLUMNS, f"{sql.METRIC_COLUMNS} pr_auc roc_auc",
    ),
)
def _monitored_regions(spark, directory):
    return slices.monitored_slices(scored_lines(spark, directory), SCORE, T, "region")


_STACK = {"SEASON": "season", "REGION": "region", "YEAR": "year", "TIME_PERIOD": "time_period"}


@query(
    "stacked_slices",
    final(
        [sql.S, _PERIOD, *[sql.confusion("per", f"c_{c}", c) for c in _STACK.values()],
         "u AS (" + " UNION ALL ".join(
             f"SELECT '{t}' AS analysis_type, CAST({c} AS VARCHAR) AS slice, * EXCLUDE ({c}, brier_score) FROM c_{c}" for t, c in _STACK.items()
         ) + ")", sql.rates("u", "m")],
        "m", "analysis_type slice", sql.COUNT_COLUMNS, f"{sql.RATE_COLUMNS} average_probability maximum_probability",
    ),
)
def _stacked(spark, directory):
    return slices.stacked_slices(period_thirds(scored_lines(spark, directory)), SCORE, T, _STACK)


@query(
    "stress_report",
    final(
        [sql.S, *sql.sweep("s", "w", 50, 150, 10),
         """n AS (SELECT 'SEASON' AS analysis_type, CAST(count(DISTINCT season) AS BIGINT) AS n FROM s UNION ALL SELECT 'REGION', count(DISTINCT region) FROM s
  UNION ALL SELECT 'YEAR', count(DISTINCT year) FROM s UNION ALL SELECT 'TIME_PERIOD', 3 UNION ALL SELECT 'PROBABILITY_BAND', 6 UNION ALL SELECT 'THRESHOLD', count(*) FROM w)""",
         """a AS (SELECT analysis_type, n, (SELECT count(*) FROM s) * CASE WHEN analysis_type = 'THRESHOLD' THEN 11 ELSE 1 END AS observations,
  (SELECT sum(actual) FROM s) * CASE WHEN analysis_type = 'THRESHOLD' THEN 11 ELSE 1 END AS events,
  CASE WHEN analysis_type = 'THRESHOLD' THEN (SELECT sum(alerts) FROM w) WHEN analysis_type <> 'PROBABILITY_BAND'
    THEN (SELECT count(*) FROM s WHERE probability >= CAST(0.09 AS DOUBLE)) END AS alerts FROM n)"""],
        "a", "analysis_type", "n observations events alerts",
    ),
)
def _stress_report(spark, directory):
    scored = scored_lines(spark, directory)
    report = slices.stress_report(scored, SCORE, T, threshold_sweep(scored, SCORE, GRID_SENSITIVITY))
    return report.groupBy("analysis_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observations").alias("observations"), F.sum("events").alias("events"),
        F.sum("alerts").alias("alerts"),
    )


_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year", "month", "actual"]
_TOP = "l_orderkey l_linenumber l_partkey l_suppkey year month actual"


def _errors_sql(kind: str, direction: str) -> str:
    return final(
        [sql.S, f"t AS (SELECT * FROM (SELECT *, {_LABEL} AS error_type FROM s) WHERE error_type = '{kind}' "
         f"ORDER BY probability {direction}, {', '.join(_KEY)} LIMIT 100)"],
        "t", "error_type", _TOP, "probability",
    )


def _errors(spark, directory, kind):
    scored = scored_lines(spark, directory).withColumn("error_type", confusion_label(F.col("actual"), alert(F.col("probability"), T)))
    return ranking.top_errors(scored, kind, "probability", _KEY).select("error_type", *_KEY, "probability")


@query("top_false_positives", _errors_sql("FALSE_POSITIVE", "DESC"))
def _top_fp(spark, directory):
    return _errors(spark, directory, "FALSE_POSITIVE")


@query("top_false_negatives", _errors_sql("FALSE_NEGATIVE", "ASC"))
def _top_fn(spark, directory):
    return _errors(spark, directory, "FALSE_NEGATIVE")


@query("top_risk", final([sql.S, f"t AS (SELECT * FROM s ORDER BY probability DESC, {', '.join(_KEY)} LIMIT 100)"], "t", "", _TOP, "probability"))
def _top_risk(spark, directory):
    return ranking.top_risk(scored_lines(spark, directory), "probability", _KEY).select(*_KEY, "probability")


@query(
    "top_regions",
    final(
        [sql.S, sql.confusion("s", "c", "l_suppkey"), sql.rates("c", "m"),
         "t AS (SELECT * FROM (SELECT * REPLACE (round(event_rate, 9) AS event_rate) FROM m) ORDER BY event_rate DESC, events DESC, l_suppkey LIMIT 15)"],
        "t", "", "l_suppkey observations events alerts", "event_rate precision recall f1",
    ),
)
def _top_regions(spark, directory):
    table = metrics.metrics_by(scored_lines(spark, directory), SCORE, T, ["l_suppkey"])
    rounded = table.withColumn("event_rate", F.round("event_rate", 9))
    top = ranking.top_slices(rounded, [("event_rate", True), ("events", True), ("l_suppkey", False)])
    return top.select("l_suppkey", "observations", "events", "alerts", "event_rate", "precision", "recall", "f1")


@query(
    "high_risk_alerts",
    final(
        [sql.S, f"a AS (SELECT *, {_DEPLOYMENT_LEVEL} AS risk_level, {_LABEL} AS prediction_status FROM s WHERE probability >= CAST(0.09 AS DOUBLE))"],
        "a", "region season risk_level prediction_status", "year month actual", "probability",
    ),
)
def _alerts(spark, directory):
    deployed = deployment_table(scored_lines(spark, directory))
    rows = ranking.high_risk_alerts(deployed, "risk_alert", "risk_probability", "year", "month")
    return rows.select("region", "season", "risk_level", "prediction_status", "year", "month", "actual", F.col("risk_probability").alias("probability"))


@query(
    "high_risk_ranked",
    final(
        [sql.S, f"a AS (SELECT *, row_number() OVER (ORDER BY probability DESC, {', '.join(_KEY)}) AS risk_rank FROM s WHERE probability >= CAST(0.09 AS DOUBLE))"],
        "a", "", f"{_TOP} risk_rank", "probability",
    ),
)
def _high_risk_ranked(spark, directory):
    scored = scored_lines(spark, directory).select(*_KEY, "probability")
    return ranking.high_risk_ranked(scored, "probability", T, _KEY).select(*_KEY, "risk_rank", "probability")
