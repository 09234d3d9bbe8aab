"""Panels and scored tables derived from star-schema tables.

Fact-to-dimension joins carry no hint: dimension tables grow with the data, so
Spark decides by measured size, and adaptive execution splits a hot key. Facts
are pruned to the needed columns before the join and combined map-side after it.
Joins are left-deep, so every right side is a table whose size Spark knows; the
estimate of a joined side is a product and would hide that it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.calendar import CALENDAR_B, MONTH_NAMES, SeasonCalendar, month_name, month_start, season


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _months(df: DataFrame, timestamp: str) -> DataFrame:
    return df.withColumns({"year": F.year(timestamp), "month_no": F.month(timestamp)})


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "entity", "year", "month_no", month_name(F.col("month_no")).alias("month"),
        month_start(F.col("year"), F.col("month_no")).alias("date"), "measure",
    )


def quantity_panel(spark: SparkSession, directory: str) -> DataFrame:
    """Shipped quantity per brand and month."""
    lines = table(spark, directory, "lineitem").select("l_partkey", "l_shipdate", "l_quantity")
    parts = table(spark, directory, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    joined = _months(lines.join(parts, F.col("l_partkey") == F.col("p_partkey")), "l_shipdate")
    return _finish(joined.groupBy("entity", "year", "month_no").agg(F.sum("l_quantity").alias("measure")))


def order_panel(spark: SparkSession, directory: str) -> DataFrame:
    """Order value per nation and month; small data leaves gaps in it."""
    orders = table(spark, directory, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, directory, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, directory, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    value = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return _finish(_months(joined, "o_orderdate").groupBy("entity", "year", "month_no").agg(value.alias("measure")))


def wide_panel(panel: DataFrame) -> DataFrame:
    """One row per entity and year with a column per month."""
    return panel.groupBy("entity", "year").agg(
        *[F.max(F.when(F.col("month_no") == i + 1, F.col("measure"))).alias(m.lower()) for i, m in enumerate(MONTH_NAMES)]
    )


def synthetic_score() -> Column:
    """A score in thousandths made of the keys: many ties, no relation to the outcome."""
    mixed = F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_partkey") * 7
    return (mixed % 1000).cast("double") / F.lit(1000.0)


def scored_lines(spark: SparkSession, directory: str, calendar: SeasonCalendar = CALENDAR_B) -> DataFrame:
    """One scored row per line item, sliced by region, season, year and month."""
    lines = table(spark, directory, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        (F.col("l_returnflag") == "R").cast("int").alias("actual"),
        synthetic_score().alias("probability"),
    )
    suppliers = table(spark, directory, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, directory, "nation").select("n_nationkey", "n_regionkey")
    regions = table(spark, directory, "region").select("r_regionkey", F.col("r_name").alias("region"))
    joined = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    p = F.col("probability")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "region",
        season(F.col("month"), calendar).alias("season"), "year", "month", "actual", "probability",
        (p * p).alias("probability_2"), F.sqrt(p).alias("probability_3"),
    )


def scored_events(events: DataFrame) -> DataFrame:
    """Event rows as scored rows: outcome and probability per event."""
    return events.select(
        "ts", "user_id", "event_type",
        (F.col("event_type") == "error").cast("int").alias("actual"),
        F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("probability"),
    )
