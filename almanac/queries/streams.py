"""Streaming and storage round trips."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from almanac.functions.calendar import SEASONS
from almanac.operators.clean import wide_to_long
from almanac.operators.ranking import best_row
from almanac.operators.sweep import GRID_POLICY, threshold_sweep
from almanac.plans import monitoring
from almanac.plans import panel as plans
from almanac.queries import sqlparts as sql
from almanac.queries.modelling import _SCORED_SQL, _given_artifacts, _level_sql, _prepared, write_policy
from almanac.queries.registry import final, query
from almanac.session import new_path, with_row
from almanac.sources import io
from almanac.sources.adapters import quantity_panel, scored_events, scored_lines, table, wide_panel
from almanac.spec import ScoreSpec
from almanac.streaming.alerts import AlertMonitor, utc_instant
from almanac.streaming.scoring import StreamScorer


# Events arrive in ten-day batches; every fortieth one comes a batch late.
_ARRIVAL = "CAST(floor((day(ts) - 1) / 10) AS INT) + CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END"
_ARRIVALS = 5


@query(
    "stream_alert_rate",
    f"""WITH e AS (SELECT ts, event_type, {_ARRIVAL} AS batch, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS actual, least(value / 500, 1) AS probability,
  date_trunc('day', ts) AS window_start FROM events),
h AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e GROUP BY batch),
m AS (SELECT e.*, coalesce(window_start + INTERVAL 1 DAY <= high - INTERVAL 1 HOUR, false) AS late FROM e JOIN h USING (batch)),
w AS (SELECT window_start, event_type, count(*) FILTER (WHERE NOT late) AS observations, count(*) FILTER (WHERE NOT late AND probability >= CAST(0.09 AS DOUBLE)) AS alerts,
  coalesce(sum(actual) FILTER (WHERE NOT late), 0) AS events, max(probability) FILTER (WHERE NOT late) AS maximum_probability, count(*) FILTER (WHERE late) AS late_rows FROM m GROUP BY 1, 2)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
  observations, alerts, CAST(events AS BIGINT) AS events, round(maximum_probability, 6) + 0.0 AS maximum_probability, late_rows,
  round(coalesce(CAST(alerts AS DOUBLE) / nullif(observations, 0), 0), 6) + 0.0 AS alert_rate, round(coalesce(CAST(events AS DOUBLE) / nullif(observations, 0), 0), 6) + 0.0 AS event_rate,
  CASE WHEN observations = 0 THEN NULL WHEN window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'WATERMARK' ELSE 'END_OF_INPUT' END AS closed_by
FROM w""",
)
def _stream_alert_rate(spark, directory):
    """All windows of a stream that ends, in several batches, with the rows that came too late for each."""
    events, source = table(spark, directory, "events"), new_path(spark, "arrivals")
    monitor = AlertMonitor(new_path(spark, "alert-windows"), ScoreSpec(), 0.09)
    batched = events.withColumn("batch", F.expr(_ARRIVAL)).withColumn("ts", utc_instant(F.col("ts")))
    for number in range(_ARRIVALS):
        batched.where(F.col("batch") == number).drop("batch").write.mode("append").parquet(source)
        monitor.run(scored_events(spark.readStream.schema(batched.drop("batch").schema).parquet(source)))
    windows, keys = monitor.windows(spark), ["window_start", "window_end", "event_type"]
    late = monitor.late(spark).groupBy(*keys).agg(F.count(F.lit(1)).alias("late_rows"))
    return windows.join(late, keys, "full").fillna(0, ["observations", "alerts", "events", "late_rows", "alert_rate", "event_rate"])


@query(
    "stream_scoring",
    final(
        [*_SCORED_SQL, f"""x AS (SELECT entity, month, season, year, outcome, CASE WHEN outcome = 'SCORED' THEN raw_probability END AS raw_probability,
  CASE WHEN outcome = 'SCORED' THEN sigmoid_probability END AS sigmoid_probability, CASE WHEN outcome = 'SCORED' THEN CASE WHEN sigmoid_probability >= t THEN 1 ELSE 0 END END AS risk_alert,
  CASE WHEN outcome = 'SCORED' THEN {_level_sql("t")} END AS risk_level, CASE WHEN outcome = 'REJECTED' THEN 'zscore is missing' END AS reject_reason
  FROM (SELECT *, CASE WHEN entity = 'Brand#11' THEN 'REJECTED' ELSE 'SCORED' END AS outcome, CASE WHEN year <= 1997 THEN CAST(0.09 AS DOUBLE) ELSE CAST(0.25 AS DOUBLE) END AS t FROM cal))"""],
        "x", "entity month season outcome risk_level reject_reason", "risk_alert", "year raw_probability sigmoid_probability",
    ),
)
def _stream_scoring(spark, directory):
    """A stored model scores rows that arrive in two batches; the policy changes in between."""
    rows = _prepared(spark, directory)
    path = _given_artifacts(spark)
    model, curve = io.load_linear(spark, f"{path}/model")
    scorer = StreamScorer(new_path(spark, "scored"), model, curve, f"{path}/policy", plans.NUMERIC_FEATURES, {"season": SEASONS})
    # One brand arrives without its z-score and is put aside.
    zscore = F.when(F.col("entity") != "Brand#11", F.col("zscore"))
    arriving = rows.withColumn("zscore", zscore).select("entity", "month", *plans.NUMERIC_FEATURES)
    source = f"{path}/arrivals"
    for part, threshold in ((F.col("year") <= 1997, monitoring.POLICY_THRESHOLD), (F.col("year") > 1997, 0.25)):
        write_policy(spark, path, threshold)
        arriving.where(part).write.mode("append").parquet(source)
        scorer.run(spark.readStream.schema(arriving.schema).parquet(source))
    tables = [spark.read.parquet(f"{scorer.path}/{name.lower()}").withColumn("outcome", F.lit(name)) for name in ("SCORED", "REJECTED")]
    return tables[0].unionByName(tables[1], allowMissingColumns=True).select(
        "entity", "year", "month", "season", "raw_probability", "sigmoid_probability", "risk_alert", "risk_level", "outcome", "reject_reason"
    )


@query(
    "csv_round_trip",
    final([sql.P, "x AS (SELECT entity, month, year, measure FROM p)"], "x", "entity month", "year", "measure"),
)
def _csv_round_trip(spark, directory):
    """Wide CSV out, declared schema in, pruned to the months and melted."""
    path = new_path(spark, "wide-csv")
    wide = wide_panel(quantity_panel(spark, directory)).withColumnRenamed("entity", "subdivision")
    totals = {c: F.lit(None).cast("double") for c in io.SEASON_TOTALS}
    io.write_table(wide.withColumns(totals), path, "csv")
    schema = io.wide_schema()
    months = [f.name for f in schema.fields[2:14]]
    raw = io.read_panel_csv(spark, path, schema).withColumnRenamed("subdivision", "entity")
    return wide_to_long(raw.select("entity", "year", *months), ["entity", "year"], months, "measure").filter(F.col("measure").isNotNull())


_SCHEMA = StructType(
    [StructField("features", ArrayType(StringType())), StructField("categories", StructType([StructField("month", ArrayType(StringType())), StructField("season", ArrayType(StringType()))]))]
)


@query(
    "schema_artifact",
    f"""WITH {sql.P}, x AS (SELECT DISTINCT entity, month FROM p)
SELECT entity, month, CAST(CASE WHEN month IN ('JAN', 'FEB') THEN 1 ELSE 0 END AS BIGINT) AS is_winter FROM x""",
)
def _schema_artifact(spark, directory):
    """The model schema goes out as JSON and closes the domain of the rows read back."""
    panel = quantity_panel(spark, directory)
    path = new_path(spark, "model-schema")
    months = panel.agg(F.sort_array(F.collect_set("month")).alias("month"))  # at most twelve names
    io.write_json_artifact(
        months.select(
            F.array(*[F.lit(c) for c in plans.NUMERIC_FEATURES]).alias("features"),
            F.struct("month", F.array(*[F.lit(s) for s in SEASONS]).alias("season")).alias("categories"),
        ),
        path,
    )
    schema = io.read_json_artifact(spark, path, _SCHEMA)
    checked = with_row(panel, schema, {"domain": "categories"})
    inside = checked.filter(F.array_contains(F.col("domain.month"), F.col("month")))
    return inside.select("entity", "month", F.col("month").isin("JAN", "FEB").alias("is_winter")).distinct()


@query(
    "policy_artifact",
    final(
        [sql.S, *sql.sweep("s", "w", 10, 170, 5), """b AS (SELECT threshold FROM (SELECT * REPLACE (round(f1, 9) AS f1) FROM w) ORDER BY f1 DESC, threshold LIMIT 1)""",
         "x AS (SELECT season, count(*) AS n, count(*) FILTER (WHERE probability >= (SELECT threshold FROM b)) AS alerts, (SELECT threshold FROM b) AS threshold FROM s GROUP BY season)"],
        "x", "season", "n alerts", "threshold",
    ),
)
def _policy_artifact(spark, directory):
    """The chosen policy is written, read back, validated and applied."""
    scored = scored_lines(spark, directory)
    sweep = threshold_sweep(scored, ScoreSpec(), GRID_POLICY).withColumn("f1", F.round("f1", 9))
    chosen = best_row(sweep, [("f1", True), ("threshold", False)])
    path = new_path(spark, "policy")
    io.write_table(chosen.select(F.lit("event").alias("target"), F.lit("sigmoid_probability").alias("probability_type"), "threshold"), path, "csv")
    judged = with_row(scored, io.load_policy(spark, path), {"threshold": "threshold"})
    return judged.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("probability") >= F.col("threshold")).alias("alerts"), F.max("threshold").alias("threshold")
    )


@query(
    "land_and_bundle",
    final(
        ["x AS (SELECT o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total, 2 AS batches, 1 AS files FROM orders GROUP BY o_orderpriority)"],
        "x", "o_orderpriority", "n batches files", "total",
    ),
)
def _land_and_bundle(spark, directory):
    """Two landings append; the bundle is one folder per table, read back with pruning."""
    orders = table(spark, directory, "orders")
    recent = F.year("o_orderdate") >= 1999
    raw = new_path(spark, "raw")
    for part in (orders.filter(~recent), orders.filter(recent)):
        io.land_raw(part, raw, "file:orders")
    bundle = new_path(spark, "bundle")
    landed = spark.read.parquet(raw).groupBy("o_orderpriority")
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    io.write_bundle(
        {
            "totals": landed.agg(F.count(F.lit(1)).alias("n"), total),
            "batches": landed.agg(
                F.countDistinct("ingestion_timestamp").alias("batches"), F.countDistinct("source_file").alias("files"),
                F.max("source_url").alias("source_url"),
            ),
        },
        bundle,
    )
    totals = io.read_panel(spark, f"{bundle}/totals", ["o_orderpriority", "n", "total"])
    return totals.join(io.read_panel(spark, f"{bundle}/batches", ["o_orderpriority", "batches", "files"]), "o_orderpriority")
