"""Models as numbers, staged boosting, importance, dictionaries, score tables: against plain computations."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from almanac.functions.calendar import season_name, season_ordinal
from almanac.operators import boosting, explain, joins, metrics, models, slices, sweep
from almanac.operators.linear import LinearModel
from almanac.sources import io
from almanac.operators.calibration import SigmoidFit
from almanac.session import new_path
from almanac.spec import ScoreSpec
from almanac.streaming.scoring import StreamScorer

SCORE = ScoreSpec()


@pytest.fixture(scope="module")
def table(spark):
    """Two informative numbers, one constant, one category; an outcome that leans on them."""
    rng = random.Random(12)
    rows = []
    for i in range(600):
        a, b, c = rng.gauss(3, 2), rng.uniform(0, 100), rng.choice("xyz")
        rows.append((i, a, b, 7.0, c, int(rng.random() < 1 / (1 + np.exp(-(a - 3 + (c == "x") - b / 50 + 1))))))
    return spark.createDataFrame(rows, "id long, a double, b double, k double, c string, y int").cache()


def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (p - y)))
    return beta


def test_logistic_fit_is_the_weighted_optimum(table):
    model = models.fit_logistic(table, ["a", "b"], [], "y", max_iter=200)
    linear = LinearModel.from_pipeline(model, ["a", "b"])
    data = table.toPandas()
    y = data["y"].to_numpy()
    want = newton(np.column_stack([np.ones(len(data)), data["a"], data["b"]]), y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))))
    slopes = [w / s for w, _, s in linear.numeric.values()]
    assert slopes == pytest.approx(want[1:], rel=1e-3)
    assert linear.intercept - sum(s * m for s, (_, m, _) in zip(slopes, linear.numeric.values())) == pytest.approx(want[0], rel=1e-3)


def test_numbers_of_a_pipeline_score_like_the_pipeline(spark, table):
    """Also a constant column and a category that training did not see; and after storage."""
    model = models.fit_logistic(table, ["a", "b", "k"], ["c"], "y")
    linear = LinearModel.from_pipeline(model, ["a", "b", "k"], ["c"])
    unseen = table.withColumn("c", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("c")))
    path = new_path(spark, "linear")
    io.save_linear(linear, SigmoidFit(2.0, -1.0), path)
    loaded, curve = io.load_linear(spark, path)
    assert loaded == linear and curve == SigmoidFit(2.0, -1.0)
    both = models.add_probability(loaded, models.add_probability(model, unseen, "pipeline"), "numbers")
    assert both.where(F.abs(F.col("pipeline") - F.col("numbers")) > 1e-9).count() == 0


def test_a_linear_model_has_one_intercept(spark):
    with pytest.raises(ValueError):
        LinearModel.from_table(spark.createDataFrame([], "kind string, name string, level string, weight double, mean double, scale double"))


def test_staged_trees_equal_the_ensemble(spark, table):
    model = models.fit_gbt(table, ["a", "b"], [], "y", {"maxIter": 6, "maxDepth": 3})
    trees = boosting.forest(table, model, ["a", "b"])
    holes = table.withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    scored = models.add_probability(model, holes, "fitted").withColumns({"flat": trees.probability(), "stages": trees.staged_margins()})
    rows = scored.collect()
    assert trees.rounds == 6 and all(len(r.stages) == 6 for r in rows)
    assert [r.flat for r in rows] == pytest.approx([r.fitted for r in rows])
    # Node by node, for one tree after another.
    for r in rows[::50]:
        total = 0.0
        for t in range(trees.rounds):
            node = 0
            for _ in range(trees.depth):
                x = (r.a if r.a is not None else float("nan"), r.b)[trees.feature[t, node]]
                node = trees.left[t, node] if x <= trees.threshold[t, node] else trees.right[t, node]
            total += trees.value[t, node]
            assert r.stages[t] == pytest.approx(total)
    assert trees.cut(2).rounds == 2


def test_early_stopping_cuts_to_the_best_round(spark, table):
    train, held_out = table.where("id % 3 > 0"), table.where("id % 3 = 0")
    trees, staged = boosting.fit_with_patience(train, held_out, ["a", "b"], [], "y", {"maxIter": 8, "maxDepth": 2, "stepSize": 0.3}, patience=3)
    quality = {r["round"]: r.pr_auc for r in staged.collect()}
    assert sorted(quality) == list(range(1, 9))
    best, last = -1.0, 1
    for i in range(1, 9):
        if quality[i] > best:
            best, last = quality[i], i
        elif i - last >= 3:
            break
    assert trees.rounds == last
    kept = held_out.select("y", trees.probability().alias("probability")).withColumnRenamed("y", "actual")
    assert metrics.ranking_metrics(kept, SCORE).first().pr_auc == pytest.approx(quality[last])


@pytest.mark.parametrize(
    "qualities, patience, want",
    [([0.1, 0.2, 0.15, 0.2, 0.1, 0.9], 3, (2, 0.2, 5)), ([0.1, 0.2, 0.3], 2, (3, 0.3, 3)), ([0.5, 0.4, 0.3, 0.2], 1, (1, 0.5, 2)), ([None, 0.1, None], 5, (2, 0.1, 3)), ([None], 2, (1, None, 1))],
)
def test_patience(spark, qualities, patience, want):
    staged = spark.createDataFrame(list(enumerate(qualities, 1)), "round int, pr_auc double")
    got = boosting.stop_early(staged, patience).first()
    assert (got.best_round, got.best_quality, got.stopped_at) == want


def test_permutation_importance_against_moving_values(spark, table):
    model = LinearModel(0.2, {"a": (1.0, 3.0, 2.0), "b": (-0.7, 50.0, 30.0)}, {"c": {"x": 0.5}})
    got = {r.feature: r for r in explain.permutation_importance(model, table, ["a", "b"], "y", ["c", "id"], repeats=2).collect()}
    data = table.toPandas().sort_values(["c", "id"]).reset_index(drop=True)
    n = len(data)

    def quality(frame):
        margin = 0.2 + (frame["a"] - 3) / 2 - 0.7 * (frame["b"] - 50) / 30 + 0.5 * (frame["c"] == "x")
        order = np.argsort(-margin.to_numpy(), kind="stable")
        y = frame["y"].to_numpy()[order]
        return float((np.cumsum(y) / np.arange(1, n + 1))[y == 1].mean())

    for f in ("a", "b"):
        losses = []
        for r in range(2):
            factor, shift = explain._shuffled(f, 42 + r)
            factor, moved = explain._coprime(factor, n), data.copy()
            target = [(factor * i + shift) % n for i in range(1, n + 1)]
            assert sorted(target) == list(range(n))
            moved.loc[target, f] = data[f].to_numpy()
            losses.append(quality(data) - quality(moved))
        assert got[f].importance_mean == pytest.approx(np.mean(losses)) and got[f].importance_std == pytest.approx(np.std(losses))


def exchanges(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") + df._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_permutations_need_as_many_exchanges_for_any_number_of_features(spark, table):
    model = LinearModel(0.2, {"a": (1.0, 3.0, 2.0), "b": (-0.7, 50.0, 30.0)})
    few = explain.permutation_importance(model, table, ["a"], "y", ["id"], repeats=1)
    many = explain.permutation_importance(model, table, ["a", "b"], "y", ["id"], repeats=3)
    assert exchanges(few) == exchanges(many)


def test_codes_of_a_million_categories(spark):
    """A dictionary larger than any broadcast, one category with a third of the rows."""
    n = 1_000_000
    values = spark.range(n).select(F.format_string("k%07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("c"))
    hot = spark.range(n // 2).select(F.lit("k0000000").alias("c"))
    codes = models.train_codes(values.union(hot), ["c"])
    asked = values.union(hot).union(spark.createDataFrame([("new",), (None,)], "c string"))
    got = models.apply_codes(asked, codes)
    wrong = ~F.coalesce(F.col("c_code") == F.substring("c", 2, 7).try_cast("int"), F.col("c_code").isNull() & (F.coalesce("c", F.lit("new")) == "new"))
    assert got.count() == n + n // 2 + 2 and got.where(wrong).count() == 0


@pytest.mark.parametrize("on", [["k"], ["k", "m"]])
def test_kept_keys_are_the_same_on_both_sides_of_the_switch(spark, rows, on):
    facts = spark.range(2000).select((F.col("id") % 11).alias("k"), F.when(F.col("id") % 13 > 0, F.col("id") % 3).cast("int").alias("m"), "id")
    keys = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (5, None), (None, 2), (40, 1)], "k long, m int")
    few, many = joins.keep_keys(facts, keys, on), joins.keep_keys(facts, keys, on, literals=1)
    assert rows(few, "id") == rows(many, "id") and 0 < few.count() < 2000
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in many._jdf.queryExecution().optimizedPlan().toString()
    assert joins.keep_keys(facts, keys.where("k > 99"), on).count() == 0


def test_score_tables_answer_as_rows_do(spark, rows):
    rng = random.Random(3)
    cells = [(rng.choice([1, 0, 0]), rng.choice([None, *[i / 40 for i in range(41)]]), rng.choice(["A", "B", None]), rng.choice([2001, 2002])) for _ in range(800)]
    df = spark.createDataFrame(cells, "actual int, probability double, season string, year int")
    counts, weighted = metrics.score_table(df, SCORE, ["season", "year"])
    assert counts.count() < df.count()
    for by in ([], ["season"], ["season", "year"]):
        for make in (
            lambda d, s: metrics.metrics_by(d, s, 0.3, by), lambda d, s: metrics.metrics_by(d, s, 0.3, by, ranking=True), lambda d, s: metrics.brier(d, s, by),
            lambda d, s: metrics.ranking_metrics(d, s, by), lambda d, s: sweep.threshold_sweep(d, s, sweep.GRID_ALERT, by),
        ):
            for a, b in itertools.zip_longest(rows(make(df, SCORE), *by), rows(make(counts, weighted), *by)):
                assert a == pytest.approx(b, nan_ok=True)
    values = np.array([p for _, p, _, _ in cells if p is not None])
    summary = slices.probability_summary(df, SCORE, 0.3).first()
    assert summary.std_probability == pytest.approx(values.std(ddof=1)) and summary.p95_probability == pytest.approx(np.quantile(values, 0.95))
    assert summary.alerts == (values >= 0.3).sum() and summary.observations == 800
    assert sum(r.observations for r in slices.reliability(df, SCORE).collect()) == len(values)


ONE_SCAN = ["policy_compare", "readiness_checks", "recent_vs_baseline", "final_policy", "reliability_deciles", "probability_summary", "alert_stability", "season_policy_metrics", "monitor_table"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_facts_are_read_once(spark, small, name, monkeypatch):
    """Counted where the facts are scanned: in the plans that write tables and in the plan of the result."""
    from almanac import session

    scans = []
    store = session.stored

    def counted(df, *args):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("l_returnflag#"))
        return store(df, *args)

    for module in ("metrics", "slices", "policy", "drift", "distribution", "calibration"):
        monkeypatch.setattr(f"almanac.operators.{module}.stored", counted, raising=False)
    for module in ("quality", "policies"):
        monkeypatch.setattr(f"almanac.queries.{module}.stored", counted, raising=False)
    result = contract.queries()[name](spark, small)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan
    # Two of them also build the feature panel.
    assert sum(s > 0 for s in scans) == (2 if name in ("monitor_table", "readiness_checks") else 1)


def test_season_names_read_back(spark, rows):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, None, 9)], "n int")
    named = df.select("n", season_name(F.col("n")).alias("season"))
    got = rows(named.select("n", "season", season_ordinal(F.col("season")).alias("back")), "n")
    assert all(r["back"] == r["n"] for r in got if r["season"] is not None)
    assert sum(r["season"] is not None for r in got) == 4


def test_stream_scorer_reads_the_policy_for_every_batch(spark, tmp_path):
    def policy(threshold, kind="sigmoid_probability"):
        row = spark.createDataFrame([("t", kind, threshold)], io.policy_schema())
        io.write_table(row, str(tmp_path / "policy"), "csv")

    model = LinearModel(0.0, {"x": (1.0, 0.0, 1.0)})
    scorer = StreamScorer(str(tmp_path / "out"), model, SigmoidFit(1.0, 0.0), str(tmp_path / "policy"), ["x"], {"season": ["WINTER", "MONSOON"]})
    batch = spark.createDataFrame([("JAN", 0.0), ("JUL", None), ("APR", 1.0)], "month string, x double")
    policy(0.9)
    scorer.process(batch, 0)
    policy(0.1)
    scorer.process(batch, 1)
    scorer.process(batch, 1)  # run again
    got = spark.read.parquet(f"{scorer.path}/scored").collect()
    assert sorted((r.batch_id, r.month, r.risk_alert) for r in got) == [(0, "JAN", False), (1, "JAN", True)]
    bad = spark.read.parquet(f"{scorer.path}/rejected").collect()
    assert sorted((r.batch_id, r.month, r.reject_reason) for r in bad if r.batch_id) == [(1, "APR", "season outside its domain"), (1, "JUL", "x is missing")]
    policy(1.5)
    with pytest.raises(Exception, match="policy must be one row"):
        scorer.process(batch, 2)
