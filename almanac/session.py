"""Small helpers around the session: shared storage and one-row lookups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can write to.

    Clusters name it in ``spark.checkpoint.dir``. Only a local session, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="almanac-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint, which keeps partitions and row order."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when the write that made them ends, instead of when the driver next collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write a table once to shared storage, by its name or to ``path``, and read it back.

    For tables that several passes read: the passes then scan columns of a file
    instead of repeating joins and windows, and lost executors cost no rework.
    """
    path = path or new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_row(df: DataFrame, one_row: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Attach columns of a one-row table as a scalar subquery (no join).

    ``columns`` maps the new name to the column of ``one_row``. The subquery is
    one column that the others unpack, so it is planned once.
    """
    packed = one_row.select(F.struct(*[F.col(source).alias(name) for name, source in columns.items()])).scalar()
    unpacked = df.withColumn("_row", packed)
    return unpacked.withColumns({name: F.col("_row")[name] for name in columns}).drop("_row")
