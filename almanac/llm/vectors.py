"""Vectors of floating point numbers as exact integers in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, id_column: str, vector: str, *keep: str) -> DataFrame:
    """``id``, ``vector`` and the kept columns of rows whose vector is not null and holds finite numbers only."""
    whole = F.forall(vector, lambda x: F.abs(x.cast("double")) < F.lit(float("inf")))
    return df.where(whole).select(F.col(id_column).alias("id"), F.col(vector).alias("vector"), *keep)


def exact(numbers: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two; Python's own integers only where 64 bits might not do."""
    if not len(numbers) or float(np.abs(numbers).max()) < 2.0**62 / scale:
        return np.floor(numbers * scale).astype(np.int64)
    # Doubles from 2**53 on are integers already; the product could leave the range of doubles.
    whole = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in numbers.tolist()]
    return np.array(whole, dtype=object)


def matrix(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    """One row per vector, scaled to integers; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = exact(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def largest(*arrays: np.ndarray) -> int:
    """The largest absolute value as a Python integer."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)
