"""Helpers around the session."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from almanac import session


def test_stored_tables_leave_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(session._CLEANUP)
    counted = spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count()
    table = session.stored(counted.join(counted.withColumnRenamed("count", "n"), "k"))
    assert not files() - before and spark.conf.get(session._CLEANUP) == setting
    # The table is read from its own files, and its source can be stored again.
    assert sorted(table.collect()) == sorted(session.stored(counted.join(counted.withColumnRenamed("count", "n"), "k")).collect())
