"""Helpers for Arrow batches: small slices, words of long texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256
# Bytes that Spark sends to a Python worker at once; its default of 64 MB is held several times over by every task.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def text_bytes(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The named columns and the whole text as UTF-8 bytes in ``_text``; other columns are never read."""
    return docs.select(*keep, F.col(text).cast("binary").alias("_text"))


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; from now on its session sends batches of ``BATCH_BYTES`` at most, or of what it was set to below that."""
    conf = df.sparkSession.conf
    if int(re.sub(r"\D", "", conf.get(_LIMIT)) or 0) > BATCH_BYTES or conf.get(_LIMIT).startswith("-"):
        conf.set(_LIMIT, f"{BATCH_BYTES}b")
    return df


def sliced(batches: Iterator[pa.RecordBatch], arrow: tuple[str, ...] = ()) -> Iterator[dict[str, list]]:
    """Slices of at most ``SLICE`` rows, as dictionaries of columns; those named in ``arrow`` stay Arrow arrays."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield {name: part.column(i) if name in arrow else part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def per_slice(
    df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, done: Callable[[], None] = lambda: None, arrow: tuple[str, ...] = ()
) -> DataFrame:
    """Apply ``function`` to slices of at most ``SLICE`` rows, as dictionaries of columns.

    Spark bounds a batch by bytes; the slices bound what Python objects a task
    holds beside it. The function is pure, so a lost task is simply run again.
    ``done`` runs at the end of a task, to free what the function has kept. Columns
    named in ``arrow`` stay Arrow arrays.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, arrow):
            out = function(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)
        done()

    return small_batches(df).mapInArrow(run, schema)


def word_chunks(data: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words between ASCII white space, a bounded stretch of the text at a time."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            gap = _SPACE.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[start:end].split()
        start = end


def word_count(data: bytes, size: int = 1 << 20) -> int:
    """The number of words between ASCII white space."""
    total, before = 0, True
    for start in range(0, len(data), size):
        raw = np.frombuffer(data, np.uint8, min(size, len(data) - start), start)
        space = (raw - np.uint8(9) < 5) | (raw == 32)
        total += int(np.count_nonzero(space[:-1] & ~space[1:])) + bool(before and not space[0])
        before = bool(space[-1])
    return total
