"""Cleaning: empty rows, names, types, duplicates, months, seasons, leakage."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import (
    CALENDAR_B,
    UNKNOWN,
    SeasonCalendar,
    clean_month_text,
    normalize_month,
    season,
    valid_month,
    valid_season,
)
from almanac.functions.scalar import no_nan
from almanac.operators.joins import many_to_one

# Columns that know the future or restate the target.
LEAKAGE_COLUMNS = [
    "persistent_drought_signal",
    "environmental_risk_score",
    "environmental_risk_level",
    "target_3m_stress",
]


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Refuse a table that lacks a required column, before anything runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every column is null."""
    return df.na.drop("all")


def standardize_columns(df: DataFrame) -> DataFrame:
    """Column names trimmed, lower-cased, blanks to underscores."""
    return df.toDF(*[re.sub(" ", "_", c.strip().lower()) for c in df.columns])


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns to double; text that is no number, and NaN, become NULL."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: no_nan(F.col(c).try_cast("double")) for c in present})


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows."""
    return df.dropDuplicates()


def dedupe_keys(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Keep the first row per key in the given order.

    ``min_by`` on a struct keeps one row per key in the map-side aggregate, so a
    key with very many copies never gathers in one task as a window would.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_by])
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return kept.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def wide_to_long(df: DataFrame, ids: Sequence[str], months: Sequence[str], value: str) -> DataFrame:
    """One row per id and month column; empty cells stay as NULL rows."""
    long = df.unpivot(list(ids), list(months), "month", value)
    return long.withColumn("month", clean_month_text(F.col("month")))


def select_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Project to a fixed feature list in order."""
    return require_columns(df, features).select(*features)


def drop_leakage(df: DataFrame, columns: Sequence[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """Remove columns that leak the outcome."""
    return df.drop(*columns)


def refuse_leakage(df: DataFrame, columns: Sequence[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """Raise when a leaking column is present."""
    present = sorted(set(columns) & set(df.columns))
    if present:
        raise ValueError(f"leakage columns found: {present}")
    return df


def drop_incomplete(df: DataFrame, numeric: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Coerce the numeric columns and drop rows missing any required field."""
    return coerce_numeric(df, numeric).na.drop(subset=[*numeric, *required])


def pick_probability(df: DataFrame, candidates: Sequence[str], out: str = "monitor_probability") -> DataFrame:
    """Use the first probability column that is present."""
    for name in candidates:
        if name in df.columns:
            return df.withColumn(out, F.col(name).try_cast("double"))
    raise ValueError(f"no probability column among {list(candidates)}")


def pick_alert(df: DataFrame, candidates: Sequence[str], probability: str, threshold: float, out: str = "monitor_alert") -> DataFrame:
    """Use the first alert column that is present, else derive it from the threshold."""
    for name in candidates:
        if name in df.columns:
            return df.withColumn(out, F.coalesce(F.col(name).try_cast("int"), F.lit(0)))
    return df.withColumn(out, F.coalesce(F.col(probability) >= threshold, F.lit(False)).cast("int"))


def invalid_month_rows(df: DataFrame, month: str = "month") -> DataFrame:
    """Rows whose month is missing or outside 1..12."""
    return df.filter(~valid_month(F.col(month)))


def alerts_only(df: DataFrame, alert: str) -> DataFrame:
    return df.filter(F.col(alert) == 1)


def repair_season(df: DataFrame, month_no: str, calendar: SeasonCalendar = CALENDAR_B, column: str = "season") -> DataFrame:
    """Overwrite the season with the one its month implies, marking corrected rows."""
    derived = season(F.col(month_no), calendar)
    wrong = ~F.upper(F.trim(F.col(column))).eqNullSafe(derived)
    return df.withColumn("season_was_wrong", wrong.cast("int")).withColumn(column, derived)


def recover_season(
    df: DataFrame,
    lookup: DataFrame | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str] = ("existing", "month", "lookup"),
    month: str = "month",
    calendar: SeasonCalendar = CALENDAR_B,
) -> DataFrame:
    """Fill the season from the first source that knows it, in the given order.

    ``lookup`` holds a season per key; it is reduced to one row per key first.
    """
    sources: dict[str, Column] = {}
    if "season" in df.columns:
        existing = F.upper(F.trim(F.col("season")))
        sources["existing"] = F.when(valid_season(existing), existing)
    sources["month"] = season(F.col(month), calendar, unknown=None)
    joined = df
    if lookup is not None:
        unique = lookup.filter(valid_season(F.col("season"))).groupBy(*keys).agg(F.min("season").alias("_lookup_season"))
        joined = many_to_one(df, unique, keys)
        sources["lookup"] = F.col("_lookup_season")
    picked = F.coalesce(*[sources[name] for name in order if name in sources], F.lit(UNKNOWN))
    return joined.withColumn("_season", picked).drop("season", "_lookup_season").withColumnRenamed("_season", "season")


def month_repair_audit(df: DataFrame, keys: Sequence[str], original: str, corrected: str) -> DataFrame:
    """One audit row per repaired month."""
    return df.select(
        *keys,
        F.col(original).alias("original_month"),
        F.col(corrected).alias("corrected_month"),
        F.concat_ws(" -> ", F.col(original).cast("string"), F.col(corrected).cast("string")).alias("conversion"),
        F.lit("ZERO_BASED_TO_CALENDAR").alias("repair_method"),
        F.lit("HIGH").alias("confidence"),
    )


def normalize_month_column(df: DataFrame, column: str = "month", out: str | None = None, keep_invalid: bool = False) -> DataFrame:
    """Mixed month spellings to month numbers."""
    return df.withColumn(out or column, normalize_month(F.col(column), keep_invalid))


def sanitize(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column: the one null rule of the library."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: no_nan(F.col(c)) for c in floating}) if floating else df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
