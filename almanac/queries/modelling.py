"""Calibration, model training, scoring, importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import boosting, calibration, explain, metrics, models
from almanac.operators.linear import LinearModel
from almanac.plans import modelling, monitoring
from almanac.plans import panel as plans
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.session import new_path, stored
from almanac.sources.adapters import quantity_panel, scored_lines
from almanac.sources.io import load_linear, load_model, load_policy, save_linear, save_model, write_table
from almanac.spec import ScoreSpec

SCORE = ScoreSpec()
TARGET = plans.SEVERE_TARGET
NUMERIC = plans.NUMERIC_FEATURES
_KEYS = ["entity", "year", "month"]


def _sigmoid_sql(slope: str, intercept: str) -> str:
    return f"1 / (1 + exp(-(({slope}) * probability + ({intercept}))))"


@query(
    "sigmoid_apply",
    final([sql.S, f"x AS (SELECT DISTINCT probability, {_sigmoid_sql('4.5', '-3.25')} AS calibrated FROM s)"], "x", "", "", "probability calibrated"),
)
def _sigmoid_apply(spark, directory):
    scored = scored_lines(spark, directory).select("probability").distinct()
    return scored.withColumn("calibrated", calibration.SigmoidFit(4.5, -3.25).apply(F.col("probability")))


# Newton steps on the penalised log-likelihood over distinct scores.
_NEWTON = """sc AS (SELECT probability AS p, CAST(count(*) AS DOUBLE) AS n, CAST(sum(actual) AS DOUBLE) AS y FROM s GROUP BY 1),
nw AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b
  UNION ALL
  SELECT step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (
    SELECT step, any_value(a) AS a, any_value(b) AS b, sum((n * q - y) * p) + any_value(a) AS ga, sum(n * q - y) AS gb,
      sum(n * q * (1 - q) * p * p) + 1 AS haa, sum(n * q * (1 - q) * p) AS hab, sum(n * q * (1 - q)) AS hbb
    FROM (SELECT nw.step, nw.a, nw.b, sc.p, sc.n, sc.y, 1 / (1 + exp(-(nw.a * sc.p + nw.b))) AS q FROM nw CROSS JOIN sc WHERE nw.step < 12)
    GROUP BY step))"""


@query(
    "sigmoid_calibration",
    f"WITH RECURSIVE {sql.S}, {_NEWTON} SELECT round(a, 4) + 0.0 AS slope, round(b, 4) + 0.0 AS intercept FROM nw WHERE step = 12",
)
def _sigmoid_calibration(spark, directory):
    fit = calibration.fit_sigmoid(scored_lines(spark, directory), SCORE)
    row = spark.range(1).select(F.lit(fit.slope).alias("slope"), F.lit(fit.intercept).alias("intercept"))
    return row.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


# The isotonic fit as max over starts of min over ends of the block means.
_ISOTONIC = """iso_n AS (SELECT probability, row_number() OVER (ORDER BY probability) AS i, CAST(sum(actual) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY probability),
iso_c AS (SELECT *, sum(y) OVER (ORDER BY i) AS cy, sum(n) OVER (ORDER BY i) AS cn FROM iso_n),
iso_b AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM iso_c a JOIN iso_c b ON b.i >= a.i),
iso_m AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM iso_b),
iso AS (SELECT probability, v AS isotonic_probability FROM (SELECT b, max(low) AS v FROM iso_m GROUP BY b) JOIN iso_n ON i = b)"""


@query("isotonic_calibration", final([sql.S, _ISOTONIC], "iso", "", "", "probability isotonic_probability"))
def _isotonic(spark, directory):
    scored = scored_lines(spark, directory).select("actual", "probability")
    model = calibration.fit_isotonic(scored, SCORE)
    return calibration.apply_isotonic(scored.select("probability").distinct(), model, "probability")


@query(
    "inference_scoring",
    final(
        [sql.S, f"x AS (SELECT *, {_sigmoid_sql('3.0', '-3.5')} AS sigmoid_probability FROM s)",
         """y AS (SELECT region, season, CASE WHEN sigmoid_probability >= CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS risk_alert,
  CASE WHEN sigmoid_probability >= CAST(0.09 AS DOUBLE) * 2 THEN 'HIGH' WHEN sigmoid_probability >= CAST(0.09 AS DOUBLE) THEN 'ALERT'
    WHEN sigmoid_probability >= CAST(0.09 AS DOUBLE) * 0.5 THEN 'WATCH' ELSE 'NORMAL' END AS risk_level, 'v1' AS model_version,
  'sigmoid_probability' AS probability_type, count(*) AS n, avg(sigmoid_probability) AS mean_probability FROM x GROUP BY ALL)"""],
        "y", "region season risk_level model_version probability_type", "risk_alert n", "mean_probability",
    ),
)
def _inference(spark, directory):
    raw = scored_lines(spark, directory).withColumnRenamed("probability", "raw_probability")
    # The policy is a one-row table that is validated before it is used.
    policy = raw.agg(F.lit("sigmoid_probability").alias("probability_type"), F.lit(monitoring.POLICY_THRESHOLD).alias("threshold"))
    threshold = models.valid_policy(policy).select("threshold").scalar()
    judged = models.checked_predictions(models.apply_policy(raw, 3.0, -3.5, threshold))
    stamped = models.stamp(judged, "v1", "sigmoid_probability", TARGET)
    keys = ["region", "season", "risk_level", "model_version", "probability_type", "risk_alert"]
    return stamped.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("sigmoid_probability").alias("mean_probability"))


_SPLIT = [
    sql.P, *sql.risk("p"), sql.TARGETS, sql.TEMPORAL,
    "ys AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT year FROM tgt))",
    "sp AS (SELECT t.*, CASE WHEN i <= floor(n * 0.70) THEN 'TRAIN' WHEN i <= floor(n * 0.85) THEN 'VALIDATION' ELSE 'TEST' END AS split FROM temporal t JOIN ys USING (year))",
]


@query(
    "median_impute",
    final(
        [*_SPLIT, "md AS (SELECT quantile_cont(lag_3m, 0.5) FILTER (WHERE split = 'TRAIN') AS a, quantile_cont(prev_12m, 0.5) FILTER (WHERE split = 'TRAIN') AS b FROM sp)",
         "x AS (SELECT entity, year, month, coalesce(lag_3m, a) AS lag_3m, coalesce(prev_12m, b) AS prev_12m FROM sp CROSS JOIN md)"],
        "x", "entity month", "year", "lag_3m prev_12m",
    ),
)
def _median_impute(spark, directory):
    rows = modelling.prepared_splits(plans.dataset_v4(quantity_panel(spark, directory)), ["lag_3m", "prev_12m"])
    return rows.select("entity", "month", "year", "lag_3m", "prev_12m")


@query(
    "mode_impute",
    final(
        [sql.S, "mo AS (SELECT season FROM s WHERE month <> 7 GROUP BY season ORDER BY count(*) DESC, season LIMIT 1)",
         "x AS (SELECT coalesce(CASE WHEN month <> 7 THEN season END, (SELECT season FROM mo)) AS season, count(*) AS n FROM s GROUP BY 1)"],
        "x", "season", "n",
    ),
)
def _mode_impute(spark, directory):
    scored = scored_lines(spark, directory).select(F.when(F.col("month") != 7, F.col("season")).alias("season"))
    return models.impute_mode(scored, scored, ["season"]).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_codes",
    final(
        [*_SPLIT, "tr AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS c FROM (SELECT DISTINCT entity FROM sp WHERE split = 'TRAIN' AND entity <> 'Brand#13'))",
         "mt AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS c FROM (SELECT DISTINCT month FROM sp WHERE split = 'TRAIN'))",
         """x AS (SELECT sp.entity, sp.month, tr.c AS entity_code, mt.c AS month_code, list_position(['WINTER', 'PRE_MONSOON', 'MONSOON', 'POST_MONSOON'], season) - 1 AS season_code,
  count(*) AS n FROM sp LEFT JOIN tr ON tr.entity = sp.entity LEFT JOIN mt ON mt.month = sp.month GROUP BY ALL)"""],
        "x", "entity month", "entity_code month_code season_code n",
    ),
)
def _category_codes(spark, directory):
    """Codes learned without one brand, which must come out as NULL; closed season codes."""
    rows = modelling.split_by_years(plans.dataset_v4(quantity_panel(spark, directory)))
    train = rows.filter((F.col("split") == "TRAIN") & (F.col("entity") != "Brand#13"))
    coded = models.apply_codes(rows, models.train_codes(train, ["entity", "month"]))
    closed = models.closed_codes({"season": ["WINTER", "PRE_MONSOON", "MONSOON", "POST_MONSOON"]}).transform(coded)
    return closed.groupBy("entity", "month", "entity_code", "month_code", F.col("season_code").cast("int").alias("season_code")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "balanced_weights",
    final(
        [*_SPLIT, "c AS (SELECT count(*) AS n, sum(target_3m_severe_anomaly) AS p FROM sp)",
         """x AS (SELECT target_3m_severe_anomaly AS target, count(*) AS rows, CASE WHEN target_3m_severe_anomaly = 1 THEN any_value(n) / (2.0 * any_value(p)) ELSE any_value(n) / (2.0 * (any_value(n) - any_value(p))) END AS weight,
  CASE WHEN target_3m_severe_anomaly = 1 THEN (any_value(n) - any_value(p)) / CAST(any_value(p) AS DOUBLE) ELSE 1 END AS positive_weight FROM sp CROSS JOIN c GROUP BY 1)"""],
        "x", "", "target rows", "weight positive_weight",
    ),
)
def _balanced_weights(spark, directory):
    rows = plans.severe_dataset(quantity_panel(spark, directory)).select(TARGET)
    weighted = models.positive_weight(models.balanced_weight(rows, TARGET), TARGET, "positive_weight")
    return weighted.groupBy(F.col(TARGET).alias("target")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("weight").alias("weight"), F.max("positive_weight").alias("positive_weight")
    )


def _prepared(spark, directory):
    """Training table, stored once: every fit passes over it many times."""
    dataset = stored(plans.scoring_rows(quantity_panel(spark, directory)), "dataset")
    return stored(modelling.prepared_splits(dataset, NUMERIC), "prepared")


def _train(rows):
    return rows.filter(F.col("split") == "TRAIN")


# A model given as numbers, so that SQL can state its scores: all numeric features, months and seasons.
_WIDE = {"year": (1995.0, 3.0), "anomaly_pct": (0.0, 100.0), **{c: (0.0, 1.0) for c in ("missing", "zscore", "month_sin", "month_cos")}}
GIVEN = LinearModel(
    -0.5,
    {c: ((7 * i % 11 - 5) / 10, *_WIDE.get(c, (100.0, 500.0))) for i, c in enumerate(NUMERIC)},
    {"month": {"JAN": 0.125, "JUL": -0.25, "DEC": 0.5}, "season": {"WINTER": 0.0625, "MONSOON": -0.125}},
)
GIVEN_CURVE = calibration.SigmoidFit(3.5, -2.75)


def _double(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _term_sql(name: str, column: str) -> str:
    weight, mean, scale = GIVEN.numeric[name]
    return f"{_double(weight)} * (({column} - {_double(mean)}) / {_double(scale)})"


def _margin_sql() -> str:
    cases = [f"coalesce(CASE {c} " + " ".join(f"WHEN '{level}' THEN {_double(w)}" for level, w in weights.items()) + " END, 0)" for c, weights in GIVEN.categories.items()]
    return " + ".join([_double(GIVEN.intercept), *[_term_sql(c, c) for c in NUMERIC], *cases])


def _level_sql(threshold: str) -> str:
    return (
        f"CASE WHEN sigmoid_probability >= {threshold} * 2 THEN 'HIGH' WHEN sigmoid_probability >= {threshold} THEN 'ALERT' "
        f"WHEN sigmoid_probability >= {threshold} * 0.5 THEN 'WATCH' ELSE 'NORMAL' END"
    )


# The prepared rows: splits by year, medians of the training rows, seasons of the model stage.
_PREPARED_SQL = [
    *_SPLIT,
    "md AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) FILTER (WHERE split = 'TRAIN') AS {c}" for c in NUMERIC) + " FROM sp)",
    f"pr AS (SELECT sp.entity, sp.month, {sql.season_case('sp.month_no', 'B')} AS season, sp.split, sp.{TARGET} AS actual, "
    + ", ".join(f"coalesce(CAST(sp.{c} AS DOUBLE), md.{c}, 0) AS {c}" for c in NUMERIC) + " FROM sp CROSS JOIN md)",
]
_SCORED_SQL = [
    *_PREPARED_SQL,
    f"raw AS (SELECT *, 1 / (1 + exp(-({_margin_sql()}))) AS raw_probability FROM pr)",
    f"cal AS (SELECT *, 1 / (1 + exp(-({_double(GIVEN_CURVE.slope)} * raw_probability + ({_double(GIVEN_CURVE.intercept)})))) AS sigmoid_probability FROM raw)",
]


@query(
    "logistic_fit",
    f"""WITH RECURSIVE {", ".join(_PREPARED_SQL)},
tr AS (SELECT zscore AS u, month_cos AS v, CAST(actual AS DOUBLE) AS y, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY actual)) AS w FROM pr WHERE split = 'TRAIN'),
nw AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c
  UNION ALL
  SELECT step + 1,
    a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    c - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM (
    SELECT step, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, sum(w * (q - y)) AS g0, sum(w * (q - y) * u) AS g1, sum(w * (q - y) * v) AS g2,
      sum(k) AS h00, sum(k * u) AS h01, sum(k * v) AS h02, sum(k * u * u) AS h11, sum(k * u * v) AS h12, sum(k * v * v) AS h22
    FROM (SELECT *, w * q * (1 - q) AS k FROM (SELECT nw.*, tr.*, 1 / (1 + exp(-(nw.a + nw.b * tr.u + nw.c * tr.v))) AS q FROM nw CROSS JOIN tr WHERE nw.step < 15))
    GROUP BY step)))
SELECT term, round(weight, 3) + 0.0 AS weight FROM (SELECT unnest(['intercept', 'zscore', 'month_cos']) AS term, unnest([a, b, c]) AS weight FROM nw WHERE step = 15)""",
)
def _logistic_fit(spark, directory):
    """The class-balanced fit on two features, in units of the raw columns, against Newton steps."""
    names = ["zscore", "month_cos"]
    model = models.fit_logistic(_train(_prepared(spark, directory)), names, [], TARGET, max_iter=200)
    linear = LinearModel.from_pipeline(model, names)
    slopes = {c: w / scale for c, (w, _, scale) in linear.numeric.items()}
    start = linear.intercept - sum(slopes[c] * linear.numeric[c][1] for c in names)
    table = spark.createDataFrame([("intercept", start), *slopes.items()], "term string, weight double")
    return table.select("term", F.round("weight", 3).alias("weight"))


@query("logistic_scores")
def _logistic(spark, directory):
    rows = _prepared(spark, directory)
    model = models.fit_logistic(_train(rows), NUMERIC, plans.CATEGORICAL_FEATURES, TARGET)
    return models.add_probability(model, rows).select(*_KEYS, "split", TARGET, "raw_probability")


@query("model_artifact")
def _artifact(spark, directory):
    """Scores of a model before it is saved and after it is loaded again, as a pipeline and as plain numbers, by split."""
    rows = _prepared(spark, directory)
    model = models.fit_logistic(_train(rows), NUMERIC, plans.CATEGORICAL_FEATURES, TARGET)
    fit = calibration.fit_sigmoid(models.add_probability(model, rows.filter(F.col("split") == "VALIDATION")), ScoreSpec(actual=TARGET, probability="raw_probability"))
    path, plain = new_path(spark, "model"), new_path(spark, "terms")
    save_model(model, fit, path)
    save_linear(LinearModel.from_pipeline(model, NUMERIC, plans.CATEGORICAL_FEATURES), fit, plain)
    (loaded, curve), (linear, _) = load_model(spark, path), load_linear(spark, plain)
    scored = models.add_probability(loaded, models.add_probability(model, rows, "before"), "after")
    scored = models.add_probability(linear, scored, "as_numbers")
    same = (fit.apply(F.col("before")) == curve.apply(F.col("after"))) & (F.abs(F.col("as_numbers") - F.col("after")) < 1e-9)
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))


# Rounds are a parameter of the learner; these keep the queries short.
_GBT = {"maxIter": 30, "maxDepth": 5, "stepSize": 0.1}


def _boosted(rows):
    codes = models.train_codes(_train(rows), plans.CATEGORICAL_FEATURES)
    coded = models.apply_codes(rows, codes)
    features = [f"{c}_code" for c in plans.CATEGORICAL_FEATURES]
    return models.fit_gbt(_train(coded), NUMERIC, features, TARGET, _GBT), coded, [*NUMERIC, *features]


@query("gbt_scores")
def _gbt(spark, directory):
    model, coded, _ = _boosted(_prepared(spark, directory))
    return models.add_probability(model, coded).select(*_KEYS, "split", TARGET, "raw_probability")


@query("gbt_early_stopping")
def _gbt_early(spark, directory):
    """Scores of the best prefix on the validation years, with the quality it was chosen for."""
    rows = _prepared(spark, directory)
    held_out = rows.filter(F.col("split") == "VALIDATION")
    trees, staged = boosting.fit_with_patience(_train(rows), held_out, NUMERIC, [], TARGET, _GBT, patience=10)
    scored = rows.select(*_KEYS, "split", TARGET, trees.probability().alias("raw_probability"), F.lit(trees.rounds).alias("best_round"))
    return scored.join(F.broadcast(staged.select(F.col("round").alias("best_round"), F.col("pr_auc").alias("validation_pr_auc"))), "best_round")


# Twelve made-up rounds: the fractional part of round * probability.
_ROUNDS, _PATIENCE = 12, 3


@query(
    "early_stopping_rule",
    final(
        [sql.S, f"st AS (SELECT k AS round, actual, probability * k - floor(probability * k) AS p FROM s, range(1, {_ROUNDS + 1}) t(k))", sql.ranking("st", "ap", "round", "p"),
         "q AS (SELECT round, round(pr_auc, 12) AS q, max(round(pr_auc, 12)) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ap)",
         "l AS (SELECT *, max(CASE WHEN best IS NULL OR q > best THEN round END) OVER (ORDER BY round) AS last FROM q)",
         f"e AS (SELECT coalesce((SELECT min(round) FROM l WHERE round - last >= {_PATIENCE}), (SELECT max(round) FROM l)) AS stopped_at)",
         "x AS (SELECT l.last AS best_round, (SELECT q FROM q WHERE round = l.last) AS best_quality, stopped_at FROM e JOIN l ON l.round = stopped_at)"],
        "x", "", "best_round stopped_at", "best_quality",
    ),
)
def _early_stopping_rule(spark, directory):
    """Patience on the average precision of staged scores, all rounds ranked in one job."""
    scored = scored_lines(spark, directory).select("actual", F.explode(F.sequence(F.lit(1), F.lit(_ROUNDS))).alias("round"), "probability")
    product = F.col("probability") * F.col("round")
    quality = metrics.ranking_metrics(scored.withColumn("probability", product - F.floor(product)), SCORE, ["round"])
    return boosting.stop_early(quality.withColumn("pr_auc", F.round("pr_auc", 12)), _PATIENCE)


@query("calibrated_policy")
def _calibrated_policy(spark, directory):
    """Train, calibrate on validation years, choose the policy there, judge the test years."""
    rows = _prepared(spark, directory)
    model = models.fit_logistic(_train(rows), NUMERIC, plans.CATEGORICAL_FEATURES, TARGET)
    scored = stored(modelling.calibrated_scores(model, rows, TARGET))
    chosen = modelling.choose_policy(scored.filter(F.col("split") == "VALIDATION"))
    return chosen.select("probability_type", "threshold", "precision", "recall", "f1", "alert_rate")


def _given_artifacts(spark) -> str:
    """The given model with its curve, and a policy, stored as a release would have them."""
    path = new_path(spark, "release")
    save_linear(GIVEN, GIVEN_CURVE, f"{path}/model")
    write_policy(spark, path, monitoring.POLICY_THRESHOLD)
    return path


def write_policy(spark, path: str, threshold: float) -> None:
    row = spark.createDataFrame([(TARGET, "sigmoid_probability", threshold)], "target string, probability_type string, threshold double")
    write_table(row, f"{path}/policy", "csv")


@query(
    "batch_scoring",
    final(
        [*_SCORED_SQL, f"""x AS (SELECT entity, month, season, year, raw_probability, sigmoid_probability, CAST(0.09 AS DOUBLE) AS policy_threshold, 'v1' AS model_version, '{TARGET}' AS target,
  CASE WHEN sigmoid_probability >= CAST(0.09 AS DOUBLE) THEN 1 ELSE 0 END AS risk_alert, {_level_sql('CAST(0.09 AS DOUBLE)')} AS risk_level FROM cal)"""],
        "x", "entity month season risk_level model_version target", "risk_alert", "year raw_probability sigmoid_probability policy_threshold",
    ),
)
def _batch_scoring(spark, directory):
    """A stored model, curve and policy applied to all rows."""
    path = _given_artifacts(spark)
    model, curve = load_linear(spark, f"{path}/model")
    scored = models.score_batch(model, _prepared(spark, directory), curve.slope, curve.intercept, load_policy(spark, f"{path}/policy"), "v1", TARGET)
    return models.checked_predictions(scored).select(
        *_KEYS, "season", "raw_probability", "sigmoid_probability", "risk_alert", "risk_level", "policy_threshold", "model_version", "target"
    )


@query("feature_ablation")
def _ablation(spark, directory):
    rows = _prepared(spark, directory)
    base = [c for c in plans.BASE_FEATURES if c in NUMERIC]
    temporal = list(plans.TEMPORAL_FEATURES)
    return models.ablation(rows, {"BASE": base, "TEMPORAL": temporal, "ALL": [*base, *temporal]}, TARGET)


@query("native_importance")
def _native(spark, directory):
    model, coded, features = _boosted(_prepared(spark, directory))
    return explain.native_importance(coded, model, features)


_REPEATS = 3
_COPIES = ", ".join(f"({n}, '{f}', {explain._shuffled(f, 42 + r)[0]}, {explain._shuffled(f, 42 + r)[1]})" for n, (f, r) in enumerate((f, r) for f in NUMERIC for r in range(_REPEATS)))


@query(
    "permutation_importance",
    final(
        [*_PREPARED_SQL, "te AS (SELECT *, row_number() OVER (ORDER BY entity, year, month) AS i, count(*) OVER () AS n FROM pr WHERE split = 'TEST')",
         f"cp AS (SELECT *, list_filter(range(f0, f0 + 2000, 2), lambda x: gcd(x, n) = 1)[1] AS factor FROM (VALUES (-1, '', 1, 0), {_COPIES}) AS t(copy, feature, f0, shift) CROSS JOIN (SELECT max(n) AS n FROM te))",
         "mv AS (SELECT copy, feature, (CAST(factor AS HUGEINT) * v.i + shift) % v.n + 1 AS place, " + ", ".join(f"v.{c}" for c in NUMERIC) + " FROM cp CROSS JOIN te v)",
         "sh AS (SELECT mv.copy, mv.feature AS moved, te.actual, te.month, te.season, " + ", ".join(f"CASE WHEN mv.feature = '{c}' THEN mv.{c} ELSE te.{c} END AS {c}" for c in NUMERIC)
         + " FROM mv JOIN te ON te.i = mv.place)",
         f"sc AS (SELECT copy, moved, actual, 1 / (1 + exp(-({_margin_sql()}))) AS p FROM sh)", sql.ranking("sc", "ap", "copy, moved", "p"),
         "ls AS (SELECT moved AS feature, (SELECT pr_auc FROM ap WHERE copy < 0) - pr_auc AS loss FROM ap WHERE copy >= 0)",
         "im AS (SELECT feature, avg(loss) AS importance_mean, stddev_pop(loss) AS importance_std FROM ls GROUP BY feature)",
         "x AS (SELECT *, row_number() OVER (ORDER BY importance_mean DESC, feature) AS rank FROM im)"],
        "x", "feature", "rank", "importance_mean importance_std",
    ),
)
def _permutation(spark, directory):
    """All numeric features of the given model, three shuffles each, on the test years."""
    rows = _prepared(spark, directory).filter(F.col("split") == "TEST")
    return explain.permutation_importance(GIVEN, rows, NUMERIC, TARGET, _KEYS, repeats=_REPEATS)


@query(
    "linear_contributions",
    final(
        [*_PREPARED_SQL, "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs({_term_sql(c, c)})) AS mean_abs_contribution FROM pr" for c in NUMERIC) + ")",
         "x AS (SELECT *, row_number() OVER (ORDER BY mean_abs_contribution DESC, feature) AS rank FROM m)"],
        "x", "feature", "rank", "mean_abs_contribution",
    ),
)
def _contributions(spark, directory):
    return explain.linear_contributions(GIVEN, _prepared(spark, directory), NUMERIC)


@query("combined_importance")
def _combined(spark, directory):
    rows = _prepared(spark, directory)
    booster = models.fit_gbt(_train(rows), NUMERIC, [], TARGET, _GBT)
    linear = models.fit_logistic(_train(rows), NUMERIC, [], TARGET)
    native = explain.native_importance(rows, booster, NUMERIC).select("feature", "normalized_importance")
    permuted = explain.permutation_importance(linear, rows.filter(F.col("split") == "TEST"), NUMERIC, TARGET, _KEYS)
    contributions = explain.linear_contributions(linear, rows, NUMERIC).select("feature", "mean_abs_contribution")
    return explain.combine_importance(native, permuted.select("feature", "importance_mean"), contributions)
