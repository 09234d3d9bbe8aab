"""Metrics, distribution helpers, ranks and policies against brute force."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.operators import calibration, checks, distribution, drift, metrics, models, policy, ranking, slices
from almanac.operators.sweep import GRID_V4, Grid, GridList, threshold_sweep
from almanac.queries import QUERIES
from almanac.spec import ScoreSpec

SCORE = ScoreSpec()
relaxed = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
scores = st.lists(st.tuples(st.sampled_from([0.0, 0.09, 0.1, 0.25, 0.5, 0.505, 0.9, 1.0]) | st.floats(0, 1), st.integers(0, 1)), min_size=1, max_size=40)


def scored(spark, pairs):
    return spark.createDataFrame([(float(p), int(y)) for p, y in pairs], "probability double, actual int")


def brute_ap(pairs):
    positives = sum(y for _, y in pairs)
    if positives in (0, len(pairs)):
        return None
    total = 0.0
    for s in sorted({p for p, _ in pairs}, reverse=True):
        above = [y for p, y in pairs if p >= s]
        here = sum(y for p, y in pairs if p == s)
        total += here / positives * (sum(above) / len(above))
    return total


def brute_auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    if not pos or not neg:
        return None
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_tied_scores(spark, rows):
    df = scored(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 0), (0.4, 1), (0.2, 0)])
    got = rows(metrics.ranking_metrics(df, SCORE))[0]
    assert got["pr_auc"] == pytest.approx(0.7555556, abs=1e-6)
    assert got["roc_auc"] == pytest.approx(0.7222222, abs=1e-6)


def test_one_class(spark, rows):
    got = rows(metrics.metrics_by(scored(spark, [(0.2, 0), (0.8, 0)]), SCORE, 0.5, ranking=True))[0]
    assert (got["pr_auc"], got["roc_auc"], got["precision"], got["recall"]) == (None, None, 0.0, 0.0)


def test_missing_probability_and_missing_slice(spark, rows):
    """NULL slices are slices; a NULL probability never alerts and does not rank."""
    cells = [("a", 0.9, 1), ("a", 0.2, 0), ("a", None, 1), (None, 0.7, 0), (None, 0.6, 1), (None, 0.1, 0)]
    df = spark.createDataFrame(cells, "region string, probability double, actual int")
    plain = {r["region"]: r for r in rows(metrics.metrics_by(df, SCORE, 0.5, ["region"]))}
    full = {r["region"]: r for r in rows(metrics.metrics_by(df, SCORE, 0.5, ["region"], ranking=True))}
    assert set(full) == {"a", None}
    for region, r in full.items():
        assert {k: r[k] for k in plain[region]} == pytest.approx(plain[region])
    assert (full["a"]["false_negative"], full["a"]["pr_auc"], full["a"]["roc_auc"]) == (1, 1.0, 1.0)
    assert full[None]["pr_auc"] == pytest.approx(0.5) and full[None]["roc_auc"] == pytest.approx(0.5)
    q = distribution.quantiles(df, ["region"], "probability", [0.5]).collect()
    assert {r.region: r.quantiles for r in q} == {"a": pytest.approx([0.55]), None: pytest.approx([0.6])}


@relaxed
@given(pairs=scores)
def test_ranking_metrics(spark, pairs):
    got = metrics.ranking_metrics(scored(spark, pairs), SCORE).first()
    assert got.pr_auc == pytest.approx(brute_ap(pairs))
    assert got.roc_auc == pytest.approx(brute_auc(pairs))


@relaxed
@given(pairs=scores, grid=st.sampled_from([GRID_V4, Grid(20, 150, 10), GridList((0.05, 0.09, 0.505))]))
def test_threshold_sweep(spark, pairs, grid):
    got = {round(r.threshold, 6): r for r in threshold_sweep(scored(spark, pairs), SCORE, grid).collect()}
    values = grid.values if isinstance(grid, GridList) else [k / 1000 for k in range(grid.start, grid.stop + 1, grid.step)]
    assert len(got) == len(values)
    for t in values:
        r = got[round(t, 6)]
        assert r.true_positive == sum(y for p, y in pairs if p >= t)
        assert r.false_positive == sum(1 - y for p, y in pairs if p >= t)
        assert r.observations == len(pairs)


@relaxed
@given(
    values=st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, -0.0, 1e-12, 5.0]), min_size=1, max_size=50),
    probs=st.lists(st.floats(0, 1), min_size=1, max_size=4),
)
def test_quantiles(spark, values, probs):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", None)], "k string, v double")
    got = distribution.quantiles(df, ["k"], "v", probs).collect()
    assert [r.k for r in got] == ["a"] and got[0].n == len(values)
    assert got[0].quantiles == pytest.approx(list(np.quantile(values, probs)), rel=1e-9, abs=1e-9)


def test_quantiles_of_a_hot_value(spark):
    """Most rows share one value; both join forms give the same answer."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 < 2, 7.0).otherwise(F.col("id") / 7).alias("v"))
    want = np.quantile([7.0 if i % 3 < 2 else i / 7 for i in range(30000)], [0.1, 0.5, 0.95])
    for bounded in (True, False):
        got = distribution.quantiles(df, [], "v", [0.1, 0.5, 0.95], bounded_keys=bounded).first()
        assert got.quantiles == pytest.approx(list(want))


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("piece_rows", [40, 50_000])
def test_prefix_sums(spark, descending, piece_rows):
    random.seed(1)
    cells = [(k, random.random(), random.randint(0, 5)) for k in "ab" for _ in range(300)]
    df = spark.createDataFrame(cells, "k string, v double, n long")
    got = distribution.prefix_sums(df, ["k"], "v", ["n"], descending=descending, piece_rows=piece_rows).collect()
    for r in got[::37]:
        before = [n for k, v, n in cells if k == r.k and (v > r.v if descending else v < r.v)]
        assert r.n_before == sum(before)
    assert len(got) == len(cells)


def test_buckets_never_invert_the_order(spark):
    random.seed(5)
    values = sorted([random.choice([-1, 1]) * 10 ** random.uniform(-12, 12) for _ in range(3000)] + [0.0, 1.0, -1.0])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    out = df.select("v", distribution.value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert all(x.b <= y.b for x, y in zip(out, out[1:]))


@pytest.mark.parametrize("value", ["0.5 + id * 1e-13", "(id * 7919 % 1000003) / 100000.0 - 5", "pow(10.0, (id % 600) - 300) * (1 + id * 1e-9)"])
def test_pieces_are_even_however_values_crowd(spark, value):
    """A million distinct scores within 1e-7, over [-5, 5], or over 600 orders of magnitude."""
    df = spark.range(1_000_000).select(F.expr(f"cast({value} as double)").alias("v")).distinct()
    placed, pieces = distribution.in_pieces(df, [F.col("v")], 50_000)
    sizes = placed.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_piece").collect()
    mean = sum(r.n for r in sizes) / pieces
    assert len(sizes) == pieces > 10 and max(r.n for r in sizes) < 2 * mean
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))


def test_ranking_metrics_of_crowded_scores_in_pieces(spark, monkeypatch):
    """Scores within 1e-7 of each other, and outside [0, 1], against counting pairs."""
    random.seed(8)
    pairs = [(random.choice([0.3 + random.randrange(400) * 1e-10, random.uniform(-5, 5)]), random.random() < 0.4) for _ in range(900)]
    monkeypatch.setattr(distribution.prefix_sums, "__defaults__", (False, 50))
    got = metrics.ranking_metrics(scored(spark, [(p, int(y)) for p, y in pairs]), SCORE).first()
    ups, downs = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    assert got.roc_auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in ups for b in downs) / len(ups) / len(downs))
    want = sum(sum(y for p, y in pairs if p >= s) / sum(p >= s for p, _ in pairs) for s in ups) / len(ups)
    assert got.pr_auc == pytest.approx(want)


@pytest.mark.parametrize("piece_rows", [300, 50_000])
def test_order_rank_with_a_hot_value(spark, piece_rows):
    """Two thirds of the rows share the leading value: the tie column still spreads them."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 < 2, 1.0).otherwise(F.col("id") * 1.0).alias("v"))
    got = {r.id: r.rank for r in ranking.order_rank(df, "v", ["id"], piece_rows=piece_rows).collect()}
    order = sorted(range(5000), key=lambda i: (-(1.0 if i % 3 < 2 else float(i)), i))
    assert [got[i] for i in order] == list(range(1, 5001))


def test_ranks_are_read_off_the_pieces(spark, small, monkeypatch):
    """Rows are placed by range partitioning and numbered as they are written: no search of split points, no window over the rows."""
    monkeypatch.setattr(ranking.order_rank, "__defaults__", ("rank", True, 500))
    got = QUERIES["high_risk_ranked"](spark, small)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "row_number" not in plan
    table = got.toPandas().sort_values("risk_rank")
    assert len(table) > 5000 and table.risk_rank.tolist() == list(range(1, len(table) + 1))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year", "month", "actual"]
    want = table.sort_values(["probability", *key], ascending=[False] + [True] * len(key))
    assert want.risk_rank.tolist() == table.risk_rank.tolist()


def test_dense_rank(spark, rows):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, -2.0), (5, None)], "k int, v double")
    got = rows(ranking.dense_rank_by(df, "v"), "k")
    assert [r["risk_rank"] for r in got] == [2, 1, 2, 3, None]


def test_ordered_split(spark):
    df = spark.createDataFrame([(y, e) for y in range(5) for e in "abc"], "year int, entity string")
    got = ranking.ordered_split(df, ["year", "entity"], 4).filter("split = 'TEST'").collect()
    assert sorted((r.year, r.entity) for r in got) == [(3, "c"), (4, "a"), (4, "b"), (4, "c")]


def test_probability_edges(spark, rows):
    p = [0, 0.02, 0.05, 0.09, 0.10, 0.15, 0.70, 1]
    df = scored(spark, [(x, 1) for x in p])
    bins = {r["probability_bin"]: r["observations"] for r in rows(slices.probability_bins(df, SCORE, 0.09))}
    assert len(bins) == 13 and sum(bins.values()) == len(p)
    assert (bins["0.00-0.02"], bins["0.02-0.04"], bins["0.09-0.10"], bins["0.10-0.12"], bins["0.70+"]) == (1, 1, 1, 1, 2)
    bands = {r["probability_band"]: r["observations"] for r in rows(slices.probability_bands(df, SCORE))}
    assert bands == {"VERY_LOW_<2%": 1, "LOW_2-5%": 1, "MODERATE_5-10%": 2, "ELEVATED_10-15%": 1, "HIGH_15-20%": 1, "CRITICAL_>=20%": 2}


def test_reliability_merges_repeated_edges(spark, rows):
    df = scored(spark, [(0.1, 0)] * 50 + [(0.5, 1)] * 50)
    got = rows(slices.reliability(df, SCORE), "bin")
    assert sum(r["observations"] for r in got) == 100
    assert [(r["mean_probability"], r["actual_event_rate"]) for r in got] == [(pytest.approx(0.1), 0.0), (pytest.approx(0.5), 1.0)]


def sweep_table(spark, cells):
    return spark.createDataFrame(cells, "threshold double, precision double, recall double, f1 double, alert_rate double")


def test_policy_tiers(spark, rows):
    good = (0.2, 0.2, 0.4, 0.27, 0.2)
    low_recall = (0.3, 0.5, 0.2, 0.29, 0.1)
    noisy = (0.1, 0.3, 0.9, 0.45, 0.6)
    all_ok = rows(policy.select_policy(sweep_table(spark, [good, low_recall, noisy])))[0]
    assert all_ok["threshold"] == 0.2 and all_ok["selection_reason"] == policy.REASON_ALL
    fallback = rows(policy.select_policy(sweep_table(spark, [low_recall, noisy])))[0]
    assert fallback["threshold"] == 0.3 and fallback["selection_reason"] == policy.REASON_FALLBACK
    assert rows(policy.select_policy(sweep_table(spark, [noisy])))[0]["threshold"] == 0.1
    rules = [
        rows(policy.select_two_tier(sweep_table(spark, t)))[0]["selection_rule"]
        for t in ([good, low_recall], [(0.1, 0.05, 0.9, 0.1, 0.6), low_recall], [low_recall])
    ]
    assert rules == ["precision_and_recall_constraints", "recall_constraint", "best_f1_fallback"]


def test_equal_f1_takes_the_documented_threshold(spark, rows):
    tied = [(t, 0.2, 0.5, 0.3, 0.2) for t in (0.1, 0.2, 0.3)]
    assert rows(policy.select_operational(sweep_table(spark, tied)))[0]["threshold"] == 0.1
    assert rows(policy.select_two_tier(sweep_table(spark, tied)))[0]["threshold"] == 0.3


def test_stability_verdicts(spark, rows):
    def verdict(a, b):
        table = lambda r: spark.createDataFrame([(r, 0.1)], "recall double, f1 double")
        return rows(policy.stability_verdict(table(a), table(b)))[0]["policy_status"]

    assert [verdict(0.3, 0.4), verdict(0.2, 0.4), verdict(0.5, 0.1)] == ["STABLE", "MODERATELY_STABLE", "UNSTABLE"]


def brute_psi(reference, current, edges, left_closed):
    side = "right" if left_closed else "left"
    shares = []
    for values in (reference, current):
        counts = np.bincount(np.searchsorted(edges, values, side=side), minlength=len(edges) + 1)
        shares.append(np.clip(counts / counts.sum(), 1e-6, None))
    r, c = shares
    return float(((c - r) * np.log(c / r)).sum())


def test_psi_against_numpy(spark, rows):
    random.seed(9)
    reference = [round(random.gauss(0, 1), 1) for _ in range(400)]
    current = [round(random.gauss(0.5, 1.2), 1) for _ in range(150)]
    data = [("REFERENCE", v, 3.0) for v in reference] + [("PRODUCTION", v, 3.0) for v in current]
    df = spark.createDataFrame(data, "period string, x double, flat double")
    steps = np.linspace(0, 1, 11)
    own = np.unique(np.quantile(reference, steps))[1:-1]
    pooled = np.unique(np.quantile(reference + current, steps))[1:-1]
    k1 = {r["feature"]: r["psi"] for r in rows(drift.psi_reference_edges(df, ["x", "flat"]))}
    k2 = {r["feature"]: r["psi"] for r in rows(drift.psi_pooled_edges(df, ["x", "flat"]))}
    assert k1["x"] == pytest.approx(brute_psi(reference, current, own, False))
    assert k2["x"] == pytest.approx(brute_psi(reference, current, pooled, True))
    assert (k1["flat"], k2["flat"]) == (0.0, pytest.approx(0.0))


def test_edges_equal_the_pandas_definition(spark):
    """Values that quantiles hit exactly: bins must come out as pandas makes them."""
    random.seed(4)
    values = [random.randint(0, 400) - random.choice([3, 7]) / 7 for _ in range(1901)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = distribution.quantiles(df, [], "v", distribution.even_steps(10)).first().quantiles
    want = pd.Series(values).quantile(np.linspace(0, 1, 11)).tolist()
    assert got == want
    scored_ = spark.createDataFrame([(abs(v) / 500, int(v) % 2) for v in values], "probability double, actual int")
    table = slices.reliability(scored_, SCORE).orderBy("bin").collect()
    cut = pd.qcut(pd.Series([abs(v) / 500 for v in values]), 10, duplicates="drop").value_counts(sort=False).tolist()
    assert [r.observations for r in table] == cut


def test_psi_needs_rows_and_counts_new_categories(spark, rows):
    data = [("REFERENCE", float(i), "a") for i in range(30)] + [("PRODUCTION", float(i), "b" if i else None) for i in range(10)]
    df = spark.createDataFrame(data, "period string, x double, c string")
    assert rows(drift.psi_reference_edges(df, ["x"]))[0]["psi"] is None
    eps = 1e-6
    want = sum((c - r) * np.log(c / r) for r, c in [(1, eps), (eps, 0.9), (eps, 0.1)])
    assert rows(drift.psi_categorical(df, ["c"]))[0]["psi"] == pytest.approx(want)


def test_psi_against_counting_with_gaps_and_crowds(spark, rows, monkeypatch):
    """Edges between reference values may fall where only current rows are; crowded values share a bucket."""
    random.seed(4)
    one = {"gap": [random.choice([0.0, 10.0]) for _ in range(60)], "crowd": [1 + random.randrange(500) * 1e-9 for _ in range(60)], "flat": [3.0] * 60, "holes": [None, float("nan"), 1.5] * 20}
    two = {"gap": [random.uniform(0, 10) for _ in range(80)], "crowd": [1 + random.randrange(700) * 1e-9 for _ in range(80)], "flat": [3.0] * 79 + [4.0], "holes": [2.5, None, -1.0, 1.5] * 20}
    names = list(one)
    data = [("REFERENCE", *r) for r in zip(*one.values())] + [("PRODUCTION", *r) for r in zip(*two.values())]
    df = spark.createDataFrame(data, "period string, " + ", ".join(f"{n} double" for n in names))
    finite = lambda v: [x for x in v if x is not None and x == x]

    def psi(name, pooled):
        ref, cur = finite(one[name]), finite(two[name])
        edges = np.unique(np.quantile(ref + cur if pooled else ref, np.arange(11) / 10))
        if not pooled and len(edges) < 3:
            return 0.0
        inner = edges[1:-1] if len(edges) > 1 else np.array([edges[0] - 1e-6, edges[0] + 1e-6])
        side = "right" if pooled else "left"
        counts = [np.bincount(np.searchsorted(inner, v, side), minlength=len(inner) + 1) / len(v) for v in (ref, cur)]
        r, c = (np.maximum(x[(counts[0] > 0) | (counts[1] > 0)], 1e-6) for x in counts)
        return float(((c - r) * np.log(c / r)).sum())

    for pooled, operator in ((False, drift.psi_reference_edges), (True, drift.psi_pooled_edges)):
        got = {r["feature"]: r["psi"] for r in rows(operator(df, names))}
        assert got == pytest.approx({n: psi(n, pooled) for n in names}, abs=1e-6)


def test_psi_spreads_the_rows_once(spark):
    df = spark.range(100).selectExpr("if(id < 50, 'REFERENCE', 'PRODUCTION') AS period", "id * 1.0 AS a", "id % 7 * 1.0 AS b")
    histogram = drift.period_histogram(df, ["a", "b"])
    plan = drift.psi_pooled_edges(df, ["a", "b"], histogram=histogram)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_isotonic_of_a_million_scores(spark):
    """Distinct scores with counts, pooled in pieces, against one pass over all of them."""
    n = 1_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) / n).alias("probability"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("r"))
    df = df.select("probability", (F.col("r") < 1000 * (0.2 + 0.6 * F.col("probability"))).cast("int").alias("actual"))
    curve = calibration.fit_isotonic(df, SCORE).toPandas().sort_values("lo")
    blocks = []
    for p, y in df.toPandas().sort_values("probability").itertuples(index=False):
        y, w, lo = int(y), 1, p
        while blocks and blocks[-1][1] * w >= y * blocks[-1][2]:
            lo, before, weight = blocks.pop()[:3]
            y, w = y + before, w + weight
        blocks.append((lo, y, w))
    assert curve["lo"].tolist() == [b[0] for b in blocks] and curve["value"].tolist() == [b[1] / b[2] for b in blocks]
    assert curve["weight"].sum() == n


@pytest.mark.parametrize("piece_rows", [5, 50_000])
@pytest.mark.parametrize("shape", ["flat", "falling", "rising", "last"])
def test_isotonic_against_pooling(spark, piece_rows, shape):
    """Also where one fall reaches back over many pieces, and where hardly anything is pooled."""
    random.seed(2)
    chance = {"flat": lambda s: 0.4, "falling": lambda s: 1 - s, "rising": lambda s: s, "last": lambda s: s if s < 0.97 else 0}[shape]
    pairs = [(s, int(random.random() < chance(s))) for s in (round(random.random(), 2) for _ in range(1500 if shape == "rising" else 300))]
    model = calibration.fit_isotonic(scored(spark, pairs), SCORE, piece_rows)
    blocks = []
    for s in sorted({p for p, _ in pairs}):
        own = [y for p, y in pairs if p == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y, n, members = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + members]
    want = {s: y / n for y, n, members in blocks for s in members}
    got = calibration.apply_isotonic(spark.createDataFrame([(s,) for s in want], "p double"), model, "p", piece_rows=piece_rows).collect()
    for r in got:
        assert r.isotonic_probability == pytest.approx(want[r.p], abs=1e-9)
    ends = calibration.apply_isotonic(spark.createDataFrame([(-1.0,), (2.0,)], "p double"), model, "p").collect()
    assert [r.isotonic_probability for r in ends] == pytest.approx([want[min(want)], want[max(want)]])


def test_median_interpolates_and_fits_on_training_rows(spark, rows):
    train = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    data = spark.createDataFrame([(None,), (7.0,)], "x double")
    assert sorted(r["x"] for r in rows(models.impute_median(data, train, ["x"]))) == [2.5, 7.0]


def test_unseen_category_is_null(spark, rows):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    codes = models.train_codes(train, ["c"])
    got = rows(models.apply_codes(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"), codes), "c")
    assert [r["c_code"] for r in got] == [0, 1, None]


def test_policy_must_be_one_valid_row(spark):
    from pyspark.errors import PySparkException

    def load(*records):
        return models.valid_policy(spark.createDataFrame(list(records), "probability_type string, threshold double")).collect()

    assert load(("sigmoid_probability", 0.09))[0].threshold == 0.09
    for bad in ([("sigmoid_probability", 1.0)], [("raw_probability", 0.1)], [("sigmoid_probability", 0.1)] * 2, [("sigmoid_probability", float("nan"))]):
        with pytest.raises(PySparkException, match="policy must be one row"):
            load(*bad)


def test_any_score_is_ranked_alike(spark):
    rows = [(-0.2, 0), (-0.5, 1), (0.4, 1), (0.1, 0), (None, 1)]
    df = spark.createDataFrame(rows, "probability double, actual int")
    one = metrics.metrics_by(df, ScoreSpec(), 0.3, ranking=True).first()
    plain = metrics.metrics_by(df, ScoreSpec(), 0.3).first()
    ranked = metrics.ranking_metrics(df.where("probability IS NOT NULL"), ScoreSpec()).first()
    for c in ("average_probability", "brier_score", "true_positive", "false_negative", "true_negative"):
        assert one[c] == pytest.approx(plain[c])
    assert one.pr_auc == pytest.approx(ranked.pr_auc) and one.roc_auc == pytest.approx(ranked.roc_auc)


def test_all_offending_values_are_listed(spark):
    df = spark.range(59).select(F.concat(F.lit("v"), "id").alias("c")).union(spark.createDataFrame([("ok",), (None,)], "c string"))
    assert checks.offending_values(df, "c", ["ok"]).count() == 59


def test_different_keys_stay_apart(spark):
    df = spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 1), ("__NA__", " x", 1), (None, "x", 1)], "k string, l string, m int")
    found = {r.check: r for r in checks.key_checks("T", df, ["k", "l"], "m", strict=True).collect()}
    assert not [r for c, r in found.items() if "DUPLICATE" in c and r.status != "PASS"]


def test_arg_max_settles_ties(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0), ("d", None)], "k string, v double")
    assert ranking.arg_max(df, "k", "v").first().asDict() == {"k": "a", "v": 2.0}


def test_rates_are_written_by_their_stored_value(spark, rows):
    """1/128 is a tie of six places, which goes to even; the double 0.1234565 lies below the tie it looks like."""
    table = spark.range(128).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), F.lit(1).alias("month"), F.lit(0.1234565).alias("p"))
    found = {r["check"]: r["value"] for r in rows(checks.key_checks("T", table, ["key"], "month", strict=True))}
    assert found["T NULL KEY ROWS"] == "rate=0.007812"
    found = {r["check"]: r["value"] for r in rows(checks.probability_checks(table, "p"))}
    assert found["PROBABILITY MINIMUM"] == found["PROBABILITY MAXIMUM"] == "0.123456"
    values = [0.0, 1.0, 0.5, 0.0234375, 0.2345675, 1e-9, 0.9999995, 12345.6789015, *[(2 * k + 1) / 2e6 for k in range(0, 10**6, 4999)]]
    written = spark.createDataFrame([(v,) for v in values], "v double").select("v", checks._fixed(F.col("v")).alias("s"))
    assert all(r.s == "%.6f" % r.v for r in written.collect())


def test_means_do_not_depend_on_the_order_of_rows(spark, rows):
    """The mean 0.4921875 is a tie of six places; sums in different orders fall on both sides of it."""
    rng = random.Random(4)
    values = [rng.randrange(1000) for _ in range(640)]
    while sum(values) != 315000:
        i = rng.randrange(640)
        values[i] = min(999, max(0, values[i] + (1 if sum(values) < 315000 else -1)))
    orders = [rng.sample(values, 640) for _ in range(20)]
    assert len({float(np.cumsum([v / 1000 for v in order])[-1]) / 640 for order in orders}) > 1
    table = spark.createDataFrame([(k, 1, v / 1000) for k, order in enumerate(orders) for v in order], "k int, actual int, probability double").coalesce(1)
    summary = slices.slice_summary(table, ScoreSpec(), 0.09, "k")
    assert {r["average_probability"] for r in rows(summary)} == {0.4921875}
    rounded = summary.withColumn("average_probability", F.round("average_probability", 6))
    assert {(r["average_probability"], r["risk_rank"]) for r in rows(ranking.dense_rank_by(rounded, "average_probability"))} == {(0.492188, 1)}
    odd = spark.createDataFrame([(1, None), (2, 1e-200), (2, 3e-200), (3, 1e200), (3, None), (4, float("nan")), (4, 0.5), (5, float("inf")), (6, 0.0), (6, -0.5)], "k int, v double")
    means = {r["k"]: r["m"] for r in rows(odd.groupBy("k").agg(metrics.steady_mean(F.col("v")).alias("m")))}
    assert means.pop(4) != 0 and means == {1: None, 2: 2e-200, 3: 1e200, 5: float("inf"), 6: -0.25}
