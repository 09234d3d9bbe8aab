"""Choosing policies and applying them."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import policy, slices
from almanac.operators.metrics import metrics_by, score_table
from almanac.operators.ranking import best_row
from almanac.operators.sweep import GRID_ALERT, GRID_FINE, GRID_POLICY, GRID_V4, threshold_sweep
from almanac.plans.monitoring import POLICY_THRESHOLD
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.queries.scored import _PERIOD
from almanac.session import stored
from almanac.sources.adapters import scored_lines
from almanac.spec import ScoreSpec

SCORE = ScoreSpec()
T = POLICY_THRESHOLD
PROBABILITIES = ["probability", "probability_2", "probability_3"]
_INTS, _DOUBLES = "true_positive false_positive false_negative true_negative", "threshold precision recall f1 alert_rate"

# The chosen row must not depend on the last digit of a float, so both sides
# order by values rounded to nine digits.
_ROUNDED = "SELECT * REPLACE (round(f1, 9) AS f1, round(precision, 9) AS precision, round(recall, 9) AS recall) FROM"


def _rounded(sweep):
    return sweep.withColumns({c: F.round(c, 9) for c in ("f1", "precision", "recall")})


@query(
    "policy_operational",
    final(
        [sql.S, *sql.sweep("s", "w", 10, 500, 10),
         f"""b AS (SELECT *, precision >= CAST(0.1 AS DOUBLE) AND recall >= CAST(0.3 AS DOUBLE) AND alert_rate <= CAST(0.3 AS DOUBLE) AS meets_constraints FROM ({_ROUNDED} w)
  ORDER BY CAST(meets_constraints AS INT) DESC, f1 DESC, threshold LIMIT 1)"""],
        "b", "", f"{_INTS} meets_constraints", _DOUBLES,
    ),
)
def _operational(spark, directory):
    sweep = threshold_sweep(scored_lines(spark, directory), SCORE, GRID_FINE)
    return policy.select_operational(_rounded(sweep)).select(*_INTS.split(), "meets_constraints", *_DOUBLES.split())


_REASON = (
    f"CASE WHEN tier = 2 THEN '{policy.REASON_ALL}' ELSE '{policy.REASON_FALLBACK}' END AS selection_reason"
)
_POLICY_TIER = """CASE WHEN precision >= CAST(0.1 AS DOUBLE) AND recall >= CAST(0.3 AS DOUBLE) AND alert_rate <= CAST(0.25 AS DOUBLE) THEN 2
    WHEN alert_rate <= CAST(0.25 AS DOUBLE) THEN 1 ELSE 0 END AS tier"""


@query(
    "policy_constrained",
    final(
        [sql.S, *sql.sweep("s", "w", 10, 170, 5),
         f"b AS (SELECT *, {_REASON} FROM (SELECT *, {_POLICY_TIER} FROM ({_ROUNDED} w)) ORDER BY tier DESC, f1 DESC, precision DESC, recall DESC, threshold LIMIT 1)"],
        "b", "selection_reason", _INTS, _DOUBLES,
    ),
)
def _constrained(spark, directory):
    sweep = threshold_sweep(scored_lines(spark, directory), SCORE, GRID_POLICY)
    return policy.select_policy(_rounded(sweep)).select("selection_reason", *_INTS.split(), *_DOUBLES.split())


@query(
    "policy_constrained_by_region",
    final(
        [sql.S, *sql.sweep("s", "w", 10, 500, 5, "region", "probability_2"),
         f"""b AS (SELECT *, {_REASON}, row_number() OVER (PARTITION BY region ORDER BY tier DESC, f1 DESC, precision DESC, recall DESC, threshold) AS rn
  FROM (SELECT *, {_POLICY_TIER} FROM ({_ROUNDED} w)))"""],
        "b", "region selection_reason", _INTS, _DOUBLES, "WHERE rn = 1",
    ),
)
def _constrained_by_region(spark, directory):
    score = ScoreSpec(probability="probability_2")
    sweep = threshold_sweep(scored_lines(spark, directory), score, GRID_V4, ["region"])
    return policy.select_policy(_rounded(sweep), partition=["region"]).select("region", "selection_reason", *_INTS.split(), *_DOUBLES.split())


_LONG = "l AS (" + " UNION ALL ".join(f"SELECT actual, '{p}' AS probability_type, {p} AS probability FROM s" for p in PROBABILITIES) + ")"
_TWO_TIER = [
    *sql.sweep("l", "w", 10, 500, 5, "probability_type"),
    f"""tt AS (SELECT *, CASE tier WHEN 2 THEN 'precision_and_recall_constraints' WHEN 1 THEN 'recall_constraint' ELSE 'best_f1_fallback' END AS selection_rule
  FROM (SELECT *, row_number() OVER (PARTITION BY probability_type ORDER BY tier DESC, f1 DESC, precision DESC, recall DESC, threshold DESC) AS rn
    FROM (SELECT *, CASE WHEN recall >= CAST(0.4 AS DOUBLE) AND precision >= CAST(0.1 AS DOUBLE) THEN 2 WHEN recall >= CAST(0.4 AS DOUBLE) THEN 1 ELSE 0 END AS tier
      FROM ({_ROUNDED} w))) WHERE rn = 1)""",
]


def _two_tier(spark, directory):
    sweep = policy.sweep_probabilities(scored_lines(spark, directory), "actual", PROBABILITIES, GRID_V4)
    return policy.select_two_tier(_rounded(sweep), partition=["probability_type"])


@query("policy_two_tier", final([sql.S, _LONG, *_TWO_TIER], "tt", "probability_type selection_rule", _INTS, _DOUBLES))
def _policy_two_tier(spark, directory):
    return _two_tier(spark, directory).select("probability_type", "selection_rule", *_INTS.split(), *_DOUBLES.split())


_QUALITY = [
    """qa AS (SELECT probability_type, count(*) AS observations, sum(actual) AS events, avg(actual) AS event_rate, avg((probability - actual) * (probability - actual)) AS brier_score,
  avg(probability) AS mean_probability, min(probability) AS minimum_probability, max(probability) AS maximum_probability FROM l GROUP BY probability_type)""",
    sql.ranking("l", "rk", "probability_type"),
    "q AS (SELECT qa.*, pr_auc, roc_auc FROM qa JOIN rk USING (probability_type))",
]
_QUALITY_DOUBLES = "event_rate brier_score mean_probability minimum_probability maximum_probability pr_auc roc_auc"


@query("model_comparison", final([sql.S, _LONG, *_QUALITY], "q", "probability_type", "observations events", _QUALITY_DOUBLES))
def _model_comparison(spark, directory):
    return policy.model_comparison(scored_lines(spark, directory), "actual", PROBABILITIES)


@query(
    "choose_calibration",
    final(
        [sql.S, _LONG, *_QUALITY, "b AS (SELECT * FROM q WHERE probability_type <> 'probability' ORDER BY round(brier_score, 9), round(pr_auc, 9) DESC LIMIT 1)"],
        "b", "probability_type", "observations events", _QUALITY_DOUBLES,
    ),
)
def _choose_calibration(spark, directory):
    quality = policy.model_comparison(scored_lines(spark, directory), "actual", PROBABILITIES)
    return policy.choose_calibration(quality.filter(F.col("probability_type") != "probability"))


@query(
    "final_policy",
    final(
        [sql.S, _LONG, *_QUALITY, *_TWO_TIER,
         """b AS (SELECT tt.* FROM tt WHERE probability_type = (SELECT probability_type FROM q WHERE probability_type <> 'probability'
  ORDER BY round(brier_score, 9), round(pr_auc, 9) DESC LIMIT 1))"""],
        "b", "probability_type selection_rule", _INTS, _DOUBLES,
    ),
)
def _final_policy(spark, directory):
    table, score = policy.probability_table(scored_lines(spark, directory), "actual", PROBABILITIES)
    chosen = policy.select_two_tier(_rounded(threshold_sweep(table, score, GRID_V4, ["probability_type"])), partition=["probability_type"])
    best = policy.final_policy(policy.compare_quality(table, score), chosen, PROBABILITIES[1:])
    return best.select("probability_type", "selection_rule", *_INTS.split(), *_DOUBLES.split())


_SEASON_BEST = [
    *sql.sweep("s", "w", 20, 150, 10, "season"),
    f"st AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY f1 DESC, recall DESC, precision DESC, threshold) AS rn FROM ({_ROUNDED} w)) WHERE rn = 1)",
]


def _season_thresholds(scored, score):
    sweep = threshold_sweep(scored, score, GRID_ALERT, ["season"])
    return best_row(_rounded(sweep), [("f1", True), ("recall", True), ("precision", True), ("threshold", False)], ["season"])


@query("policy_by_season", final([sql.S, *_SEASON_BEST], "st", "season", _INTS, _DOUBLES))
def _policy_by_season(spark, directory):
    best = policy.season_thresholds(scored_lines(spark, directory), SCORE, GRID_ALERT)
    return best.select("season", *_INTS.split(), *_DOUBLES.split())


_SEASON_JUDGED = [
    *_SEASON_BEST,
    """sj AS (SELECT s.actual, s.region, s.season, s.probability, coalesce(st.threshold, (SELECT avg(threshold) FROM st WHERE season <> 'MONSOON')) AS season_threshold
  FROM s LEFT JOIN st ON st.season = s.season AND st.season <> 'MONSOON')""",
    sql.confusion("sj", "sc", threshold="season_threshold"), sql.rates("sc", "sm"),
]


@query(
    "season_policy_metrics",
    final([sql.S, *_SEASON_JUDGED, "x AS (SELECT *, 'SEASON_AWARE' AS policy FROM sm)"], "x", "policy", sql.COUNT_COLUMNS, sql.RATE_COLUMNS),
)
def _season_policy_metrics(spark, directory):
    """One season is left out of the thresholds, so its rows take the mean of the others."""
    scored, score = score_table(scored_lines(spark, directory), SCORE, ["season"])
    thresholds = stored(_season_thresholds(scored, score).filter(F.col("season") != "MONSOON"), "thresholds")
    return policy.season_policy_metrics(scored, score, thresholds)


@query(
    "policy_compare",
    final(
        [sql.S, *_SEASON_BEST,
         "sj AS (SELECT s.actual, s.probability, st.threshold AS season_threshold FROM s JOIN st USING (season))",
         sql.confusion("sj", "sc", threshold="season_threshold"), sql.rates("sc", "sm"), sql.confusion("s", "gc"), sql.rates("gc", "gm"),
         "u AS (SELECT 'GLOBAL' AS policy, 0 AS o, * FROM gm UNION ALL SELECT 'SEASON_AWARE', 1, * FROM sm)",
         f"v AS (SELECT policy FROM (SELECT *, {_POLICY_TIER} FROM ({_ROUNDED} u)) ORDER BY tier DESC, f1 DESC, precision DESC, recall DESC, o LIMIT 1)",
         "x AS (SELECT u.*, policy = (SELECT policy FROM v) AS selected FROM u)"],
        "x", "policy", f"{sql.COUNT_COLUMNS} selected", sql.RATE_COLUMNS,
    ),
)
def _policy_compare(spark, directory):
    scored, score = score_table(scored_lines(spark, directory), SCORE, ["season"])
    by_season = policy.season_policy_metrics(scored, score, _season_thresholds(scored, score), fallback=policy.FALLBACK_THRESHOLD)
    return policy.compare_policies(policy.global_policy_metrics(scored, score, T), by_season)


@query(
    "policy_predictions",
    final(
        [sql.S, """x AS (SELECT region, season, year, CASE WHEN probability >= CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS final_alert,
  CASE WHEN probability >= CAST(0.09 AS DOUBLE) THEN 'HIGH' WHEN probability >= CAST(0.09 AS DOUBLE) * 0.75 THEN 'WATCH'
    WHEN probability >= CAST(0.09 AS DOUBLE) * 0.5 THEN 'LOW' ELSE 'NORMAL' END AS alert_level, actual FROM s)""",
         """y AS (SELECT region, season, year, final_alert, alert_level, CASE WHEN final_alert = actual THEN 1 ELSE 0 END AS correct_prediction,
  CASE WHEN actual = 1 THEN CASE final_alert WHEN 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_NEGATIVE' END
    ELSE CASE final_alert WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'TRUE_NEGATIVE' END END AS error_type, count(*) AS n FROM x GROUP BY ALL)"""],
        "y", "region season alert_level error_type", "year final_alert correct_prediction n",
    ),
)
def _policy_predictions(spark, directory):
    rows = policy.policy_predictions(scored_lines(spark, directory), SCORE, T)
    keys = ["region", "season", "alert_level", "error_type", "year", "final_alert", "correct_prediction"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "stability_verdict",
    final(
        [sql.S, _PERIOD, sql.confusion("s", "c1", "season"), sql.rates("c1", "m1"), sql.confusion("per", "c2", "time_period"), sql.rates("c2", "m2"),
         """v AS (SELECT (SELECT min(recall) FROM m1) AS min_season_recall, (SELECT min(f1) FROM m1) AS min_season_f1,
  (SELECT min(recall) FROM m2) AS min_temporal_recall, (SELECT min(f1) FROM m2) AS min_temporal_f1)""",
         """x AS (SELECT *, CASE WHEN least(min_season_recall, min_temporal_recall) >= 0.3 THEN 'STABLE'
  WHEN least(min_season_recall, min_temporal_recall) >= 0.15 THEN 'MODERATELY_STABLE' ELSE 'UNSTABLE' END AS policy_status FROM v)"""],
        "x", "policy_status", "", "min_season_recall min_season_f1 min_temporal_recall min_temporal_f1",
    ),
)
def _stability(spark, directory):
    scored = scored_lines(spark, directory)
    return policy.stability_verdict(metrics_by(scored, SCORE, T, ["season"]), slices.metrics_by_period(scored, SCORE, T))


@query(
    "long_report",
    """WITH """ + sql.S + """, c AS (SELECT count(*) AS n, sum(actual) AS events, count(*) FILTER (WHERE probability >= CAST(0.09 AS DOUBLE)) AS alerts FROM s)
SELECT 'FINAL_POLICY' AS section, 'observations' AS metric, CAST(n AS VARCHAR) AS value FROM c UNION ALL
SELECT 'FINAL_POLICY', 'events', CAST(events AS VARCHAR) FROM c UNION ALL SELECT 'FINAL_POLICY', 'alerts', CAST(alerts AS VARCHAR) FROM c
UNION ALL SELECT 'FINAL_POLICY', 'policy', 'GLOBAL'""",
)
def _long_report(spark, directory):
    table = policy.global_policy_metrics(scored_lines(spark, directory), SCORE, T)
    return policy.long_report(table, "FINAL_POLICY", ["observations", "events", "alerts", "policy"])
