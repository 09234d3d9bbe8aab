"""Streaming alert-rate monitor over event-time windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.scalar import flag, rate
from almanac.session import new_path
from almanac.spec import ScoreSpec


def utc_instant(timestamp: Column) -> Column:
    """A timestamp without zone read as UTC: event time needs an instant."""
    return F.from_utc_timestamp(timestamp.cast("timestamp"), F.current_timezone())


def utc_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session's zone."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def event_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of the folder read as a file stream, schema taken from the file.

    Columns without a time zone become instants.
    """
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: utc_instant(F.col(c)) for c in zoneless}) if zoneless else stream


def _window_counts(score: ScoreSpec, threshold: float) -> list[Column]:
    """What is kept of a window; each can be added up again."""
    p = F.col(score.probability)
    return [
        F.count(F.lit(1)).alias("observations"),
        F.sum(flag(p >= threshold)).alias("alerts"),
        F.sum(score.actual).alias("events"),
        F.max(p).alias("maximum_probability"),
    ]


def _with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {"alert_rate": rate(F.col("alerts"), F.col("observations")), "event_rate": rate(F.col("events"), F.col("observations"))}
    )


def stream_alert_rate(
    stream: DataFrame, score: ScoreSpec, threshold: float, timestamp: str = "ts", by: str = "event_type",
    window: str = "1 day", watermark: str = "1 hour",
) -> DataFrame:
    """Alerts and events per tumbling window and key.

    A window is final once the watermark has passed its end; state for older
    windows is dropped. Counts are combined map-side before they reach the state,
    so a hot key costs one row per task.
    """
    counts = stream.withWatermark(timestamp, watermark).groupBy(F.window(timestamp, window), F.col(by)).agg(*_window_counts(score, threshold))
    named = counts.select(
        utc_clock(F.col("window.start")).alias("window_start"), utc_clock(F.col("window.end")).alias("window_end"), by,
        "observations", "alerts", "events", "maximum_probability",
    )
    return _with_rates(named)


@dataclass(frozen=True)
class AlertMonitor:
    """Alert windows of a stream that ends, without losing its last windows or its late rows.

    A windowed aggregate in append mode never writes windows that are open when the
    input ends, and drops late rows unseen. Here each micro-batch adds its counts to
    those of the open windows, marks windows behind the watermark as closed, and
    puts rows that come for a closed window aside. The watermark of a batch is the
    latest event of the batches before it less ``watermark``.

    ``path`` is a folder in shared storage. Everything is written per batch id, so a
    batch that is run again after a failure replaces what it wrote. Open windows are
    all that a batch reads back: one row per window and key.
    """

    path: str
    score: ScoreSpec
    threshold: float
    timestamp: str = "ts"
    by: str = "event_type"
    window: str = "1 day"
    watermark: str = "1 hour"

    def _of(self, what: str, batch_id: int) -> str:
        return f"{self.path}/{what}/batch_id={batch_id}"

    def _mark(self, spark: SparkSession, batch_id: int):
        """The latest event time up to a batch, None before the first one."""
        if batch_id < 0:
            return None
        return spark.read.schema("high timestamp").parquet(self._of("marks", batch_id)).first()["high"]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch."""
        spark, keys = batch.sparkSession, ["window_start", "window_end", self.by]
        before = self._mark(spark, batch_id - 1)
        span = F.window(self.timestamp, self.window)
        limit = lambda high: F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {self.watermark}")
        passed = lambda high: F.coalesce(F.col("window_end") <= limit(high), F.lit(False))
        rows = batch.withColumns({"window_start": span["start"], "window_end": span["end"]}).persist()
        try:
            rows.where(passed(before)).write.mode("overwrite").parquet(self._of("late", batch_id))
            high = rows.agg(F.max(self.timestamp)).first()[0]
            high = max((x for x in (before, high) if x is not None), default=None)
            counts = rows.where(~passed(before)).groupBy(*keys).agg(*_window_counts(self.score, self.threshold))
            if batch_id > 0:
                kept = spark.read.schema(counts.schema.add("closed", "boolean")).parquet(self._of("windows", batch_id - 1))
                counts = counts.unionByName(kept.where("NOT closed").drop("closed"))
            total = counts.groupBy(*keys).agg(
                *[F.sum(c).alias(c) for c in ("observations", "alerts", "events")], F.max("maximum_probability").alias("maximum_probability")
            )
            total.withColumn("closed", passed(high)).write.mode("overwrite").parquet(self._of("windows", batch_id))
            spark.createDataFrame([(high,)], "high timestamp").write.mode("overwrite").parquet(self._of("marks", batch_id))
        finally:
            rows.unpersist()

    def run(self, stream: DataFrame) -> None:
        """Take in all available input, from where the last run ended."""
        query = (
            stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def windows(self, spark: SparkSession) -> DataFrame:
        """Every window once, with ``closed_by``: WATERMARK, or END_OF_INPUT for those that were still open."""
        table = spark.read.option("mergeSchema", False).parquet(f"{self.path}/windows")
        last = table.agg(F.max("batch_id")).scalar()
        final = table.where(F.col("closed") | (F.col("batch_id") == last))
        named = final.select(
            utc_clock(F.col("window_start")).alias("window_start"), utc_clock(F.col("window_end")).alias("window_end"), self.by,
            "observations", "alerts", "events", "maximum_probability", F.when(F.col("closed"), "WATERMARK").otherwise("END_OF_INPUT").alias("closed_by"),
        )
        return _with_rates(named)

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came after their window was closed, as they came, with the window and the batch."""
        rows = spark.read.parquet(f"{self.path}/late")
        return rows.withColumns({c: utc_clock(F.col(c)) for c in ("window_start", "window_end")})


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input and return what it wrote."""
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
