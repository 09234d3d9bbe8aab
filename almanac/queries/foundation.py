"""Cleaning, reshaping, months, seasons and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions.calendar import (
    CALENDAR_A,
    CALENDAR_B,
    MONTH_NAMES,
    fix_zero_based_months,
    month_number,
    normalize_month,
    season,
    season_ordinal,
)
from almanac.functions.scalar import composite_key, squash_text
from almanac.operators import clean
from almanac.plans.panel import clean_wide
from almanac.queries import sqlparts as sql
from almanac.queries.registry import final, query
from almanac.sources.adapters import quantity_panel, scored_lines, table, wide_panel

_MONTH_COLUMNS = [m.lower() for m in MONTH_NAMES]
_PIVOT = "w AS (SELECT entity, year, " + ", ".join(
    f"max(measure) FILTER (WHERE month_no = {i + 1}) AS {m}" for i, m in enumerate(_MONTH_COLUMNS)
) + " FROM p GROUP BY entity, year)"


@query("clean_wide", final([sql.P, _PIVOT], "w", "entity", "year", " ".join(_MONTH_COLUMNS)))
def _clean_wide(spark, directory):
    wide = wide_panel(quantity_panel(spark, directory))
    raw = wide.select(
        F.col("entity").alias(" Entity "), F.col("year").cast("string").alias("YEAR"),
        *[F.coalesce(F.col(m).cast("string"), F.lit("NA")).alias(f"{m.title()} ") for m in _MONTH_COLUMNS],
    )
    return clean_wide(raw.unionAll(raw), "entity")


@query(
    "unpivot_months",
    final(
        [sql.P, "k AS (SELECT DISTINCT entity, year FROM p)",
         f"u AS (SELECT k.entity, k.year, {sql.MONTHS}[m] AS month, measure FROM k CROSS JOIN range(1, 13) AS r(m) "
         "LEFT JOIN p ON p.entity = k.entity AND p.year = k.year AND p.month_no = m)"],
        "u", "entity month", "year", "measure",
    ),
)
def _unpivot_months(spark, directory):
    wide = wide_panel(quantity_panel(spark, directory))
    return clean.wide_to_long(wide, ["entity", "year"], _MONTH_COLUMNS, "measure")


@query(
    "month_normalize",
    f"""WITH o AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS m, o_orderkey % 6 AS kind FROM orders),
n AS (SELECT kind, CASE WHEN kind IN (0, 1, 2, 3) THEN m WHEN kind = 4 AND m + 6 <= 12 THEN m + 6 END AS month_no FROM o)
SELECT CAST(kind AS BIGINT) AS kind, CAST(month_no AS BIGINT) AS month_no, count(*) AS n FROM n GROUP BY kind, month_no""",
)
def _month_normalize(spark, directory):
    orders = table(spark, directory, "orders").select(
        F.month("o_orderdate").alias("m"), (F.col("o_orderkey") % 6).alias("kind")
    )
    short = F.date_format(F.make_date(F.lit(2000), F.col("m"), F.lit(1)), "MMM")
    long = F.date_format(F.make_date(F.lit(2000), F.col("m"), F.lit(1)), "MMMM")
    spelled = (
        F.when(F.col("kind") == 0, F.upper(short))
        .when(F.col("kind") == 1, F.concat(F.lit("  "), F.lower(long), F.lit(" ")))
        .when(F.col("kind") == 2, F.col("m").cast("string"))
        .when(F.col("kind") == 3, F.col("m").cast("double").cast("string"))
        .when(F.col("kind") == 4, (F.col("m") + 6).cast("string"))
        .otherwise("XYZ")
    )
    return orders.withColumn("month_no", normalize_month(spelled)).groupBy("kind", "month_no").agg(F.count(F.lit(1)).alias("n"))


def _season_sql(calendar: str) -> str:
    return final(
        [sql.P, f"x AS (SELECT entity, year, month, month_no, {sql.season_case('month_no', calendar)} AS season FROM p)",
         "y AS (SELECT *, CASE season WHEN 'WINTER' THEN 0 WHEN 'PRE_MONSOON' THEN 1 WHEN 'MONSOON' THEN 2 ELSE 3 END AS season_ordinal FROM x)"],
        "y", "entity month season", "year month_no season_ordinal",
    )


def _with_season(spark, directory, calendar):
    panel = quantity_panel(spark, directory)
    named = panel.select("entity", "year", "month", month_number(F.col("month"), strict=True).alias("month_no"))
    labelled = named.withColumn("season", season(F.col("month_no"), calendar, strict=True))
    return labelled.withColumn("season_ordinal", season_ordinal(F.col("season")))


@query("season_calendar_a", _season_sql("A"))
def _season_a(spark, directory):
    return _with_season(spark, directory, CALENDAR_A)


@query("season_calendar_b", _season_sql("B"))
def _season_b(spark, directory):
    return _with_season(spark, directory, CALENDAR_B)


@query(
    "dedupe_key",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) + 0.0 AS l_quantity
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
WHERE rn = 1""",
)
def _dedupe_key(spark, directory):
    lines = table(spark, directory, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return clean.dedupe_keys(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("dedupe_rows", "SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem")
def _dedupe_rows(spark, directory):
    return clean.dedupe_rows(table(spark, directory, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"))


@query(
    "numeric_coercion",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS quantity
FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_returnflag""",
)
def _numeric_coercion(spark, directory):
    lines = table(spark, directory, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("quantity")
    )
    usable = clean.drop_incomplete(lines, ["quantity"], ["l_returnflag"])
    return usable.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query(
    "text_keys",
    """SELECT concat_ws('|', trim(c_mktsegment), coalesce(CAST(CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS VARCHAR), '__NA__'), '__MISSING_COLUMN__') AS key,
  'SEGMENT ' || c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1, 2""",
)
def _text_keys(spark, directory):
    customers = table(spark, directory, "customer").select(
        "c_mktsegment", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("c_nationkey"),
        F.concat(F.lit("  SEGMENT \t "), F.col("c_mktsegment"), F.lit("  ")).alias("padded"),
    )
    keyed = customers.select(
        composite_key(customers, ["c_mktsegment", "c_nationkey", "c_absent"]).alias("key"), squash_text(F.col("padded")).alias("label")
    )
    return keyed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "month_repair",
    """WITH m AS (SELECT o_orderpriority, CAST(month(o_orderdate) AS BIGINT) - 1 AS original_month FROM orders)
SELECT o_orderpriority, original_month, original_month + 1 AS corrected_month,
  original_month || ' -> ' || (original_month + 1) AS conversion, 'ZERO_BASED_TO_CALENDAR' AS repair_method, 'HIGH' AS confidence, count(*) AS n
FROM m GROUP BY o_orderpriority, original_month""",
)
def _month_repair(spark, directory):
    orders = table(spark, directory, "orders").select("o_orderpriority", (F.month("o_orderdate") - 1).alias("code"))
    fixed = fix_zero_based_months(orders.withColumn("month", F.col("code")), "month")
    audit = clean.month_repair_audit(fixed, ["o_orderpriority"], "code", "month")
    return audit.groupBy(*audit.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "season_repair",
    f"""WITH {sql.S}, r AS (SELECT season, CASE WHEN season <> {sql.season_case('month', 'A')} THEN 1 ELSE 0 END AS wrong FROM s)
SELECT season, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS season_was_wrong FROM r GROUP BY season""",
)
def _season_repair(spark, directory):
    scored = scored_lines(spark, directory, CALENDAR_A).select("season", "month")
    repaired = clean.repair_season(scored, "month", CALENDAR_B)
    return repaired.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("season_was_wrong").alias("season_was_wrong"))


_RECOVERY = f"""WITH {sql.S},
lookup AS (SELECT l_orderkey, min(season) AS lookup_season FROM s GROUP BY l_orderkey),
m AS (SELECT region, CASE l_linenumber % 3 WHEN 0 THEN season END AS existing, CASE WHEN l_linenumber IN (4, 5) THEN NULL ELSE season END AS from_month,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE lookup_season END AS looked_up
  FROM s JOIN lookup USING (l_orderkey))
SELECT region, coalesce({{order}}, 'UNKNOWN') AS season, count(*) AS n FROM m GROUP BY 1, 2"""


def _recovered(spark, directory, order):
    scored = scored_lines(spark, directory).select("region", "season", "month", "l_orderkey", "l_linenumber")
    # The lookup knows every order except for line 5, whose key is masked below.
    lookup = scored.select("l_orderkey", "season")
    kind = F.col("l_linenumber") % 3
    damaged = scored.withColumns(
        {
            "season": F.when(kind == 0, F.lower("season")).when(kind == 1, "n/a"),
            "month": F.when(~F.col("l_linenumber").isin(4, 5), F.col("month")),
            "l_orderkey": F.when(F.col("l_linenumber") != 5, F.col("l_orderkey")),
        }
    )
    recovered = clean.recover_season(damaged, lookup, ["l_orderkey"], order)
    return recovered.groupBy("region", "season").agg(F.count(F.lit(1)).alias("n"))


@query("season_recovery", _RECOVERY.format(order="existing, from_month, looked_up"))
def _season_recovery(spark, directory):
    return _recovered(spark, directory, ("existing", "month", "lookup"))


@query("season_recovery_lookup_first", _RECOVERY.format(order="existing, looked_up, from_month"))
def _season_recovery_lookup_first(spark, directory):
    return _recovered(spark, directory, ("existing", "lookup", "month"))
