"""Streams: scoring with a reject sink, windows over several batches, late rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from almanac.functions.calendar import SEASONS
from almanac.operators import models
from almanac.session import new_path
from almanac.sources import io
from almanac.spec import ScoreSpec
from almanac.streaming.alerts import AlertMonitor, stream_alert_rate
from almanac.streaming.scoring import stream_score, write_stream


def test_bad_rows_are_rejected_with_a_reason(spark, tmp_path):
    train = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "x double, y int")
    model = models.fit_logistic(train, ["x"], [], "y", 10)
    data = spark.createDataFrame([("JAN", 1.0), ("13", 1.0), ("JUL", None)], "month string, x double")
    source = str(tmp_path / "in")
    data.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(data.schema).parquet(source)
    good, bad = stream_score(stream, model, 1.0, 0.0, 0.5, ["x"], {"season": SEASONS})
    for name, table in {"good": good, "bad": bad}.items():
        write_stream(table, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "good")).collect()
    assert [(r.month, r.season) for r in kept] == [("JAN", "WINTER")]
    assert kept[0].risk_alert == (kept[0].sigmoid_probability >= 0.5)
    rejected = {r.month: r.reject_reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert rejected == {"13": "season outside its domain", "JUL": "x is missing"}


def test_windows_across_batches_and_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)

    def batch(hours):
        cells = [(start + dt.timedelta(hours=h), "error", 1, p) for h, p in hours]
        return spark.createDataFrame(cells, "ts timestamp, event_type string, actual int, probability double")

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = batch([(0, 0.5)]).schema
    # Day one in two batches, then rows that close it, then a row too late for it.
    for hours in ([(1, 0.5), (2, 0.01)], [(5, 0.2)], [(50, 0.5)], [(3, 0.9), (75, 0.5)]):
        batch(hours).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        write_stream(stream_alert_rate(stream, ScoreSpec(), 0.09), out, state).awaitTermination()
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(str(r.window_start), r.observations, r.alerts) for r in got] == [("2024-01-01 00:00:00", 3, 2), ("2024-01-03 00:00:00", 1, 1)]


def test_monitor_keeps_open_windows_and_late_rows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)

    def batch(hours):
        cells = [(start + dt.timedelta(hours=h), k, 1, p) for h, k, p in hours]
        return spark.createDataFrame(cells, "ts timestamp, event_type string, actual int, probability double")

    monitor = AlertMonitor(str(tmp_path / "monitor"), ScoreSpec(), 0.09)
    arrivals = [[(1, "a", 0.5), (2, None, 0.01)], [(5, "a", 0.2)], [(50, "a", None)], [(3, "a", 0.9), (49, "b", 0.3), (75, "a", 0.5)], []]
    for number, hours in enumerate(arrivals):
        monitor.process(batch(hours), number)
        monitor.process(batch(hours), number)  # a batch that is run again changes nothing
    found = {(str(r.window_start)[:10], r.event_type): (r.observations, r.alerts, r.closed_by) for r in monitor.windows(spark).collect()}
    assert found == {
        ("2024-01-01", "a"): (2, 2, "WATERMARK"), ("2024-01-01", None): (1, 0, "WATERMARK"),
        ("2024-01-03", "a"): (1, 0, "WATERMARK"), ("2024-01-03", "b"): (1, 1, "WATERMARK"), ("2024-01-04", "a"): (1, 1, "END_OF_INPUT"),
    }
    assert [(str(r.ts), r.probability, r.batch_id) for r in monitor.late(spark).collect()] == [("2024-01-01 03:00:00", 0.9, 3)]


def test_monitor_of_an_empty_stream(spark, tmp_path):
    monitor = AlertMonitor(str(tmp_path / "monitor"), ScoreSpec(), 0.09)
    monitor.process(spark.createDataFrame([], "ts timestamp, event_type string, actual int, probability double"), 0)
    assert monitor.windows(spark).collect() == [] and monitor.late(spark).collect() == []


def test_json_and_csv_artifacts(spark, tmp_path):
    policy = spark.createDataFrame([("t", "sigmoid_probability", 0.09)], io.policy_schema())
    io.write_table(policy, str(tmp_path / "policy"), "csv")
    assert io.load_policy(spark, str(tmp_path / "policy")).first().threshold == 0.09
    io.write_json_artifact(policy, str(tmp_path / "json"))
    assert io.read_json_artifact(spark, str(tmp_path / "json"), io.policy_schema()).first().threshold == 0.09


def test_scan_reads_only_the_asked_columns(spark, small):
    plan = io.read_panel(spark, f"{small}/lineitem.parquet", ["l_orderkey"]).filter(F.col("l_orderkey") > 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "PushedFilters: [IsNotNull(l_orderkey), GreaterThan" in text
    assert len(io.wide_schema().fields) == 19


def test_shared_folder_is_used(spark):
    assert new_path(spark, "x") != new_path(spark, "x")
