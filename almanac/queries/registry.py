"""Registered queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its result goes through ``finish``."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, directory: finish(function(spark, directory))
        if sql:
            ORACLE[name] = sql
        return function

    return register


def finish(df: DataFrame) -> DataFrame:
    """Common result types: rounded doubles, long integers, text dates."""
    columns = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            # Adding zero turns a rounded -0.0 into 0.0.
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif kind in ("integer", "short", "byte", "boolean"):
            c = c.cast("long")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def final(ctes: list[str], source: str, texts: str = "", ints: str = "", doubles: str = "", where: str = "") -> str:
    """SQL whose outer select has the types of ``finish``."""
    columns = [f'"{c}"' for c in texts.split()]
    columns += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    columns += [f'round(CAST("{c}" AS DOUBLE), {DIGITS}) + 0.0 AS "{c}"' for c in doubles.split()]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return f"{head}SELECT {', '.join(columns)} FROM {source} {where}"
