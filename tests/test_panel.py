"""Panel operators on gaps, nulls, single rows and zero means."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from almanac.functions.calendar import CALENDAR_A
from almanac.operators import clean, episodes, features, joins, profiles, splits, targets
from almanac.plans import panel as plans
from almanac.spec import PanelSpec

SPEC = PanelSpec()


def panel(spark, cells):
    return spark.createDataFrame(cells, "entity string, year int, month_no int, measure double")


def test_single_observation_has_no_zscore(spark, rows):
    got = rows(features.add_zscore(features.add_baseline(panel(spark, [("a", 2000, 1, 5.0)]), SPEC), SPEC))[0]
    assert (got["historical_mean"], got["historical_std"], got["zscore"], got["condition"]) == (5.0, 0.0, None, None)


def test_zero_mean_gives_nulls(spark, rows):
    df = panel(spark, [("a", 2000, 1, 0.0), ("a", 2001, 1, 0.0)])
    base = rows(features.climatology(df, SPEC))[0]
    assert base["coefficient_of_variation"] is None
    got = rows(features.add_anomaly(features.add_baseline(df, SPEC), SPEC), "year")
    assert [r["anomaly_pct"] for r in got] == [None, None]


def test_nulls_in_windows(spark, rows):
    df = panel(spark, [("a", 2000, m, v) for m, v in enumerate([None, None, 2.0, None, 4.0], 1)])
    got = rows(features.previous_sums(features.rolling_sums(df, SPEC, (3,)), SPEC, (3,)), "month_no")
    assert [r["measure_3m"] for r in got] == [None, None, 2.0, 2.0, 6.0]
    assert [r["prev_3m"] for r in got] == [None, None, None, 2.0, 2.0]
    flagged = rows(plans.panel_features(df.withColumn("month", F.lit("X"))), "month_no")
    assert [r["missing"] for r in flagged] == [1, 1, 0, 1, 0]
    assert [r["deficit"] for r in flagged] == [None, None, 0.0, None, 0.0]


def test_calendar_mode_sees_gaps(spark, rows):
    df = panel(spark, [("a", 2000, 1, 1.0), ("a", 2000, 2, 2.0), ("a", 2000, 5, 5.0)])
    by_row = rows(features.lags(df, SPEC, (1,)), "month_no")
    by_month = rows(features.lags(df, SPEC, (1,), calendar=True), "month_no")
    assert [r["lag_1m"] for r in by_row] == [None, 1.0, 2.0]
    assert [r["lag_1m"] for r in by_month] == [None, 1.0, None]


def test_gap_breaks_an_episode(spark, rows):
    cells = [("a", 2000, m, dry) for m, dry in [(1, 1), (2, 1), (4, 1), (5, 1), (6, 1), (7, 0)]]
    df = spark.createDataFrame(cells, "entity string, year int, month_no int, is_dry int")
    got = rows(episodes.episode_length(episodes.episodes(df, SPEC), SPEC), "month_no")
    assert [r["dry_episode_length"] for r in got] == [2, 2, 3, 3, 3, 0]
    assert [r["running_length"] for r in got] == [1, 2, 1, 2, 3, 0]
    assert [r["persistent_drought_signal"] for r in got] == [0, 0, 1, 1, 1, 0]


def test_targets_against_brute_force(spark, rows):
    random.seed(3)
    cells = []
    for e in "abc":
        index = 24000
        for _ in range(60):
            index += 1 if random.random() < 0.9 else 2
            z = None if random.random() < 0.1 else random.uniform(-3, 3)
            cells.append((e, (index - 1) // 12, (index - 1) % 12 + 1, z))
    df = spark.createDataFrame(cells, "entity string, year int, month_no int, zscore double")
    got = rows(targets.full_horizon(targets.target_any_below(df, SPEC), SPEC), "entity", "year", "month_no")
    want = []
    for e in "abc":
        own = [c for c in cells if c[0] == e]
        for i, (_, y, m, _) in enumerate(own):
            ahead = own[i + 1 : i + 4]
            if len(ahead) == 3 and ahead[2][1] * 12 + ahead[2][2] == y * 12 + m + 3:
                want.append((e, y, m, int(any(a[3] is not None and a[3] <= -1.5 for a in ahead))))
    assert [(r["entity"], r["year"], r["month_no"], r["target_3m_severe_anomaly"]) for r in got] == want


def test_one_shuffle_serves_the_chain(spark, small):
    """Windows and profile share the entity's partitioning."""
    from almanac.sources.adapters import quantity_panel

    risk = plans.risk_table(quantity_panel(spark, small))
    for table in (profiles.regional_profile(risk, SPEC), plans.dataset_v4(quantity_panel(spark, small))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        # The panel's own grouping, and one for everything after it.
        assert plan.count("Exchange hashpartitioning(entity") == 2, plan


def test_ranks_and_profiles(spark, small):
    from almanac.sources.adapters import quantity_panel

    ranked = plans.regional_ranking(quantity_panel(spark, small)).toPandas().sort_values("risk_rank")
    assert list(ranked.risk_rank) == list(range(1, len(ranked) + 1))
    assert ranked.average_risk_score.is_monotonic_decreasing
    assert (ranked.persistent_drought_months <= ranked.dry_months).all()
    assert ranked.maximum_risk_score.between(0, 100).all()


def test_dataset_has_no_leakage_and_unique_keys(spark, small):
    from almanac.sources.adapters import quantity_panel

    data = plans.dataset_v4(quantity_panel(spark, small))
    assert data.columns == [*plans.BASE_FEATURES, *plans.TEMPORAL_FEATURES, plans.SEVERE_TARGET]
    assert data.count() == data.select("entity", "year", "month").distinct().count()


def test_reference_period_hides_the_future(spark, rows):
    df = panel(spark, [("a", y, 1, float(v)) for y, v in [(2000, 1), (2001, 3), (2002, 100)]])
    got = rows(features.add_baseline(df, SPEC, (2000, 2001)), "year")
    assert [r["historical_mean"] for r in got] == [2.0, 2.0, 2.0]


def test_checked_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    right = spark.createDataFrame([(1, "p")], "k int, b string")
    assert joins.checked_join(left, right, ["k"]).count() == 2
    with pytest.raises(PySparkException, match="repeated key 1"):
        joins.checked_join(left, right, ["k"], validate="one_to_one").collect()
    with pytest.raises(PySparkException, match="right side: repeated key"):
        joins.checked_join(right, left, ["k"]).collect()


def test_hot_keys_are_split(spark):
    """Most facts share one key; adaptive execution must be able to split it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 40000, 1, 8)
        facts = ids.select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"), "id")
        lookup = ids.select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        for joined in (joins.lookup_left(facts, lookup, ["k"], ["v"]), joins.semi_filter(facts, lookup.groupBy("k").count(), ["k"])):
            assert joined.count() == 40000
            joined.write.format("noop").mode("overwrite").save()
            result = joined.collect()
            assert len(result) == 40000
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_join_target_keeps_every_row(spark):
    features_ = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, x double")
    target = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    assert joins.join_target(features_, target, ["k"]).count() == 2
    with pytest.raises(PySparkException, match="without target"):
        joins.join_target(features_, target.filter("k = 1"), ["k"]).collect()


def test_dedupe_keys_keeps_the_first(spark, rows):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k int, o int, v string")
    assert [r["v"] for r in rows(clean.dedupe_keys(df, ["k"], ["o"]), "k")] == ["a", "b"]


def test_season_profile_is_four_per_entity(spark, small):
    from almanac.sources.adapters import quantity_panel

    table = plans.seasonal_ranking(quantity_panel(spark, small), calendar=CALENDAR_A)
    assert table.groupBy("entity").count().filter("count != 4").count() == 0


def test_year_splits(spark, rows):
    df = spark.createDataFrame([(y, v) for y in range(2000, 2010) for v in range(3)], "year int, v int")
    got = {r["year"]: r["split"] for r in rows(splits.split_by_years(df))}
    assert [y for y, s in sorted(got.items()) if s == "TRAIN"] == list(range(2000, 2007))
    assert [y for y, s in sorted(got.items()) if s == "VALIDATION"] == [2007]
    with pytest.raises(PySparkException, match="empty split: TEST"):
        splits.split_by_ranges(df, {"TRAIN": (2000, 2009), "TEST": (2020, 2021)}).collect()


def test_recover_season_order(spark, rows):
    df = spark.createDataFrame(
        [(1, "monsoon", 1), (2, "??", 1), (3, None, 99), (4, None, 99)], "k int, season string, month int"
    )
    lookup = spark.createDataFrame([(2, "MONSOON"), (3, "PRE_MONSOON"), (3, "PRE_MONSOON")], "k int, season string")
    by_month = rows(clean.recover_season(df, lookup, ["k"]), "k")
    assert [r["season"] for r in by_month] == ["MONSOON", "WINTER", "PRE_MONSOON", "UNKNOWN"]
    by_lookup = rows(clean.recover_season(df, lookup, ["k"], ("existing", "lookup", "month")), "k")
    assert [r["season"] for r in by_lookup] == ["MONSOON", "MONSOON", "PRE_MONSOON", "UNKNOWN"]
