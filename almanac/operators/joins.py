"""Joins whose cardinality is part of the contract."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import SEASONS

# As many keys as a filter may hold.
KEY_LITERALS = 1000


def unique_on(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The same rows, raising at run time when a key repeats.

    The check is a grouped aggregate with map-side combine on the join key, so it
    needs no shuffle beyond the one the join makes, and a repeated key collapses
    before it travels.
    """
    rest = [c for c in df.columns if c not in keys]
    # Column by column: a struct buffer would rule out hash aggregation.
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    message = F.concat(F.lit(f"{what}: repeated key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    checked = grouped.filter(F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return checked.select(*df.columns)


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join facts to a grouped table although one key may hold much of the facts.

    A join on the grouping keys alone would reuse the grouped side's partitioning,
    and adaptive execution only splits hot keys when both sides are shuffled for
    the join. The second equality, on a hash of the key, asks for that shuffle;
    the grouped side is the small one. Rows with a NULL key match nothing.
    """
    mark = F.xxhash64(*[F.col(k) for k in on])
    joined = left.withColumn("_hash", mark).join(right.withColumn("_hash", mark), [*on, "_hash"], how)
    return joined.drop("_hash")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """Join that refuses repeated keys on the sides that must be unique.

    ``validate`` is one_to_one, one_to_many, many_to_one or many_to_many.
    """
    one_left, one_right = (side == "one" for side in validate.split("_to_"))
    left = unique_on(left, on, "left side") if one_left else left
    right = unique_on(right, on, "right side") if one_right else right
    if one_right and not one_left:
        return many_to_one(left, right, on, how)
    return left.join(right, list(on), how)


def join_baseline(df: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts with their baseline. The baseline has one row per key by construction.

    No hint: the baseline grows with the number of entities, so the choice of a
    broadcast is left to the size Spark measures.
    """
    return df.join(baseline, list(keys), "left")


def assemble(base: DataFrame, parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left 1:1 joins on one key: every side is clustered on it once."""
    result = unique_on(base, on, "base")
    for i, part in enumerate(parts):
        result = result.join(unique_on(part, on, f"part {i + 1}"), list(on), "left")
    return result


def join_target(features: DataFrame, target: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner 1:1 join that raises when a feature row has no target.

    Row count is kept by construction: both sides are unique on the key, and a
    missing partner raises instead of dropping the row.
    """
    marked = unique_on(target, on, "target").withColumn("_has_target", F.lit(True))
    joined = unique_on(features, on, "features").join(marked, list(on), "left")
    missing = F.raise_error(F.lit("feature row without target")).cast("boolean")
    return joined.filter(F.coalesce(F.col("_has_target"), missing)).drop("_has_target")


def lookup_left(df: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_lookup") -> DataFrame:
    """Left join against one row per key; clashing column names get a suffix.

    The kept row is the smallest of its key, so the result does not depend on
    row order.
    """
    kept = lookup.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_row"))
    named = {c: c + suffix if c in df.columns else c for c in columns}
    right = kept.select(*keys, *[F.col("_row")[c].alias(n) for c, n in named.items()])
    return many_to_one(df, right, keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", equal: Sequence[str] = ()) -> DataFrame:
    """Join in which NULL keys match each other: a missing slice value is a slice.

    ``equal`` names further keys that are never NULL.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in [*keys, *equal]})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    for k in equal:
        condition = condition & (F.col(k) == F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in [*keys, *equal]])


def semi_filter(df: DataFrame, keys_df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table, even when one key holds many rows."""
    return many_to_one(df, keys_df.select(*on), on, "left_semi")


def keep_keys(df: DataFrame, keys_df: DataFrame, on: Sequence[str], literals: int = KEY_LITERALS) -> DataFrame:
    """Rows whose key occurs in the other table, by a filter where there are few keys.

    The keys are measured first: at most ``literals`` distinct ones become a set in
    the filter, which reaches the scan, and the rows are not shuffled at all. More
    keys than that are joined as in ``semi_filter``. NULL keys match nothing.
    """
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    found = keys_df.select(*on).where(known).distinct().limit(literals + 1).collect()
    if len(found) > literals:
        return semi_filter(df, keys_df, on)
    if not found:
        return df.where(F.lit(False))
    if len(on) == 1:
        return df.where(F.col(on[0]).isin([row[0] for row in found]))
    return df.where(F.struct(*on).isin([F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(on, row)]) for row in found]))


def apply_season_threshold(
    df: DataFrame,
    thresholds: DataFrame,
    fallback: float | None = None,
    season: str = "season",
    out: str = "season_threshold",
) -> DataFrame:
    """Attach each row's season threshold; unknown seasons take the fallback.

    Without a fallback the mean of the season thresholds is used. Only the four
    seasons are kept of the threshold table, so the broadcast is four rows.
    """
    known = thresholds.filter(F.col(season).isin(*SEASONS)).groupBy(season).agg(F.max("threshold").alias(out))
    joined = df.join(F.broadcast(known), season, "left")
    spare = F.lit(float(fallback)) if fallback is not None else known.agg(F.avg(out)).scalar()
    return joined.withColumn(out, F.coalesce(F.col(out), spare))


def union_all(*tables: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Stack tables by column name."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=allow_missing)
    return result


def unexpected_values(df: DataFrame, column: str, domain: Sequence) -> DataFrame:
    """Distinct values outside a closed domain."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*domain)).select(column).distinct()
