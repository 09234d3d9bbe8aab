"""Population stability, feature drift and monitoring decisions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.levels import PSI_LABELS, PSI_LABELS_V4, PSI_MODERATE, PSI_SIGNIFICANT, psi_class
from almanac.functions.scalar import PSI_EPSILON, flag, psi_term, rate
from almanac.operators.distribution import even_steps, interpolate, prefix_sums, value_bucket
from almanac.operators.joins import union_all
from almanac.operators.ranking import row_rank
from almanac.session import stored, with_row

# PSI needs this many rows per period; quantile bins per feature.
MIN_PSI_ROWS = 20
PSI_BINS = 10


@dataclass(frozen=True)
class Periods:
    """A label column and its two values."""

    column: str = "period"
    reference: str = "REFERENCE"
    current: str = "PRODUCTION"

    def is_reference(self) -> Column:
        return F.col(self.column) == self.reference

    def is_current(self) -> Column:
        return F.col(self.column) == self.current


def label_periods(df: DataFrame, year: str, last_reference: int, first_current: int, periods: Periods = Periods()) -> DataFrame:
    """Label rows by year; years between the two periods are left out."""
    label = F.when(F.col(year) <= last_reference, periods.reference).when(F.col(year) >= first_current, periods.current)
    return df.withColumn(periods.column, label).filter(F.col(periods.column).isNotNull())


def _long(df: DataFrame, features: Sequence[str], periods: Periods) -> DataFrame:
    """One (period, feature, value) row per numeric cell."""
    numeric = df.select(periods.column, *[F.col(c).cast("double").alias(c) for c in features])
    return numeric.unpivot([periods.column], list(features), "feature", "value")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def _psi_from_bins(bins: DataFrame, key: str) -> DataFrame:
    """PSI per feature from (feature, bin, reference count, current count)."""
    feature = Window.partitionBy("feature")
    shares = bins.withColumns(
        {
            "_r": rate(F.col("_ref"), F.sum("_ref").over(feature)),
            "_c": rate(F.col("_cur"), F.sum("_cur").over(feature)),
        }
    )
    return shares.groupBy("feature").agg(
        F.sum(psi_term(F.col("_r"), F.col("_c"))).alias("psi"),
        F.sum("_ref").alias("_ref_rows"),
        F.sum("_cur").alias("_cur_rows"),
    )


def period_histogram(df: DataFrame, features: Sequence[str], periods: Periods = Periods()) -> DataFrame:
    """``feature, _bucket, _ref, _cur``: rows of either period in every value bucket, stored.

    The one pass that spreads rows by feature. Counts add up map-side, and the
    number of buckets is bounded however many rows there are.
    """
    long = _long(df, features, periods).filter(_finite(F.col("value")))
    return stored(long.groupBy("feature", value_bucket(F.col("value")).alias("_bucket")).agg(*_period_counts(periods)), "histogram")


def _period_counts(periods: Periods) -> list[Column]:
    return [F.count_if(periods.is_reference()).alias("_ref"), F.count_if(periods.is_current()).alias("_cur")]


def _values_in(df: DataFrame, features: Sequence[str], periods: Periods, buckets: DataFrame) -> DataFrame:
    """``feature, _bucket, _v, _ref, _cur``: counts of the single values of a few buckets.

    ``buckets`` has a few rows per feature. Rows are read again, but only cells in
    these buckets leave the scan.
    """
    sets = buckets.groupBy("feature").agg(F.collect_set("_bucket").alias("b"))
    packed = sets.agg(F.map_from_entries(F.collect_list(F.struct("feature", "b"))).alias("sets"))
    rows = with_row(df.select(periods.column, *[F.col(c).cast("double").alias(c) for c in features]), packed, {"_sets": "sets"})

    def cell(c: str) -> Column:
        bucket = value_bucket(F.col(c))
        inside = _finite(F.col(c)) & F.array_contains(F.col("_sets")[c], bucket)
        return F.when(inside, F.struct(F.lit(c).alias("feature"), bucket.alias("_bucket"), F.col(c).alias("_v")))

    cells = rows.select(periods.column, F.explode(F.array_compact(F.array(*[cell(c) for c in features]))).alias("_cell"))
    return cells.groupBy("_cell.feature", "_cell._bucket", "_cell._v").agg(*_period_counts(periods))


def _edges_and_values(
    df: DataFrame, features: Sequence[str], periods: Periods, histogram: DataFrame, weight: Column, steps: Sequence[float]
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct quantiles per feature (``_edges``), the buckets searched for them, and the values in those buckets.

    ``weight`` says which rows the quantiles are of. The histogram tells the buckets
    that hold the wanted ranks; only their values are counted one by one.
    """
    group = Window.partitionBy("feature")
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = histogram.withColumn("_n", weight).where("_n > 0")
    located = held.withColumns({"_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_total": F.sum("_n").over(group)})
    # By way of percent, as the usual data-frame libraries do.
    position = lambda q: (F.col("_total") - 1) * F.lit(float(q) * 100 / 100)
    ranks = [(F.floor(position(q)).cast("long"), F.ceil(position(q)).cast("long")) for q in steps]
    covers = lambda rank, start: (rank >= start) & (rank < start + F.col("_n"))
    wanted = reduce(lambda x, y: x | y, [covers(r, F.col("_offset")) for pair in ranks for r in pair])
    # At most two buckets per quantile and feature.
    searched = located.where(wanted).select("feature", "_bucket", "_offset", "_total")
    values = _values_in(df, features, periods, searched).withColumn("_n", weight)
    placed = prefix_sums(values, ["feature", "_bucket"], "_v", ["_n"])
    at = placed.join(F.broadcast(searched), ["feature", "_bucket"])
    start = F.col("_offset") + F.col("_n_before")
    picks = [F.max(F.when(covers(r, start), F.col("_v"))).alias(f"_{end}{i}") for i, pair in enumerate(ranks) for end, r in zip(("lo", "hi"), pair)]
    found = at.groupBy("feature").agg(F.max("_total").alias("_total"), *picks)
    quantile = [interpolate(F.col(f"_lo{i}"), F.col(f"_hi{i}"), position(q) - F.floor(position(q))) for i, q in enumerate(steps)]
    edges = stored(found.select("feature", F.array_sort(F.array_distinct(F.array(*quantile))).alias("_edges")), "edges")
    return edges, searched.select("feature", "_bucket"), placed.select("feature", "_bucket", "_v", "_ref", "_cur")


def _bin_counts(histogram: DataFrame, inner: DataFrame, values: DataFrame, searched: DataFrame, closed_left: bool) -> DataFrame:
    """Counts per feature and bin; bin = number of inner edges below the value.

    A bucket without an edge lies in one bin as a whole; values of buckets with an
    edge are compared one by one.
    """
    # Edges and searched buckets have a few rows per feature: bounded by the number of columns.
    below = lambda edge, v: (edge <= v) if closed_left else (edge < v)
    singles = values.join(F.broadcast(inner), "feature")
    singles = singles.select("feature", F.size(F.filter("_inner", lambda e: below(e, F.col("_v")))).alias("_bin"), "_ref", "_cur")
    whole = histogram.join(F.broadcast(searched), ["feature", "_bucket"], "left_anti").join(F.broadcast(inner), "feature")
    whole = whole.select("feature", F.size(F.filter("_inner", lambda e: value_bucket(e) < F.col("_bucket"))).alias("_bin"), "_ref", "_cur")
    return singles.unionByName(whole).groupBy("feature", "_bin").agg(F.sum("_ref").alias("_ref"), F.sum("_cur").alias("_cur"))


def psi_reference_edges(
    df: DataFrame, features: Sequence[str], periods: Periods = Periods(), bins: int = PSI_BINS, histogram: DataFrame | None = None
) -> DataFrame:
    """PSI with bin edges at the quantiles of the reference period.

    Bins are right-closed with open ends. Too few rows give NULL, fewer than two
    distinct inner intervals give 0. ``histogram`` may be given where it is known.
    """
    histogram = period_histogram(df, features, periods) if histogram is None else histogram
    edges, searched, values = _edges_and_values(df, features, periods, histogram, F.col("_ref"), even_steps(bins))
    inner = edges.select(
        "feature", F.size("_edges").alias("_count"),
        F.when(F.size("_edges") > 2, F.slice("_edges", 2, F.size("_edges") - 2)).otherwise(F.array().cast("array<double>")).alias("_inner"),
    )
    # An interpolated edge may fall into a bucket where only current rows are.
    spots = inner.select("feature", F.explode("_inner").alias("_e")).select("feature", value_bucket(F.col("_e")).alias("_bucket")).distinct()
    more = histogram.select("feature", "_bucket").join(F.broadcast(spots), ["feature", "_bucket"], "left_semi")
    more = more.join(F.broadcast(searched), ["feature", "_bucket"], "left_anti")
    if not more.isEmpty():
        values = values.unionByName(_values_in(df, features, periods, more))
        searched = searched.unionByName(more)
    table = _psi_from_bins(_bin_counts(histogram, inner.select("feature", "_inner"), values, searched, False), "feature")
    enough = (F.col("_ref_rows") >= MIN_PSI_ROWS) & (F.col("_cur_rows") >= MIN_PSI_ROWS)
    scored = table.join(F.broadcast(inner.select("feature", "_count")), "feature")
    value = F.when(~enough, F.lit(None).cast("double")).when(F.col("_count") < 3, 0.0).otherwise(F.col("psi"))
    return _all_features(df, features, scored.select("feature", value.alias("psi")))


def psi_pooled_edges(
    df: DataFrame, features: Sequence[str], periods: Periods = Periods(), bins: int = PSI_BINS, histogram: DataFrame | None = None
) -> DataFrame:
    """PSI with bin edges at the quantiles of both periods together.

    Bins are left-closed with open ends; a constant column gets a narrow bin
    around its value. A period without values gives NULL. ``histogram`` may be given
    where it is known.
    """
    histogram = period_histogram(df, features, periods) if histogram is None else histogram
    edges, searched, values = _edges_and_values(df, features, periods, histogram, F.col("_ref") + F.col("_cur"), even_steps(bins))
    only = F.col("_edges")[0]
    inner = edges.select(
        "feature",
        F.when(F.size("_edges") >= 2, F.slice("_edges", 2, F.size("_edges") - 2))
        .otherwise(F.array(only - PSI_EPSILON, only + PSI_EPSILON))
        .alias("_inner"),
    )
    table = _psi_from_bins(_bin_counts(histogram, inner, values, searched, True), "feature")
    both = (F.col("_ref_rows") > 0) & (F.col("_cur_rows") > 0)
    return _all_features(df, features, table.select("feature", F.when(both, F.col("psi")).alias("psi")))


def psi_categorical(df: DataFrame, features: Sequence[str], periods: Periods = Periods()) -> DataFrame:
    """PSI over the categories seen in either period; NULL is a category."""
    text = df.select(
        periods.column,
        *[F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias(c) for c in features],
    ).unpivot([periods.column], list(features), "feature", "category")
    counts = text.groupBy("feature", "category").agg(
        F.count_if(periods.is_reference()).alias("_ref"), F.count_if(periods.is_current()).alias("_cur")
    )
    # The number of categories can grow with the data, so totals come from their
    # own aggregate (one row per feature) and not from a window over categories.
    totals = counts.groupBy("feature").agg(F.sum("_ref").alias("_rt"), F.sum("_cur").alias("_ct"))
    shares = counts.join(F.broadcast(totals), "feature")
    term = psi_term(rate(F.col("_ref"), F.col("_rt")), rate(F.col("_cur"), F.col("_ct")))
    table = shares.groupBy("feature").agg(F.sum(term).alias("psi"))
    return _all_features(df, features, table)


def _all_features(df: DataFrame, features: Sequence[str], scored: DataFrame) -> DataFrame:
    """One row per asked feature, also for those without any value."""
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(scored, "feature", "left")


def _by_feature(df: DataFrame, features: Sequence[str], measures: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """Aggregates of every feature from one pass over the rows as they are: one row, then one row per feature."""
    wide = df.agg(*[make(c).alias(f"{name}/{c}") for name, make in measures.items() for c in features])
    cells = [F.struct(F.lit(c).alias("feature"), *[F.col(f"`{name}/{c}`").alias(name) for name in measures]) for c in features]
    return wide.select(F.explode(F.array(*cells)).alias("_cell")).select("_cell.*")


def missing_by_period(df: DataFrame, features: Sequence[str], periods: Periods = Periods()) -> DataFrame:
    """Rows and missing rates of every feature in both periods, in one pass."""
    lacking = lambda c: F.col(c).isNull().cast("int")
    table = _by_feature(
        df, features,
        {
            "reference_rows": lambda c: F.count_if(periods.is_reference()),
            "production_rows": lambda c: F.count_if(periods.is_current()),
            "reference_missing_rate": lambda c: F.avg(F.when(periods.is_reference(), lacking(c))),
            "production_missing_rate": lambda c: F.avg(F.when(periods.is_current(), lacking(c))),
        },
    )
    return table.withColumn(
        "missing_rate_change", F.col("production_missing_rate") - F.col("reference_missing_rate")
    )


def feature_drift(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], periods: Periods = Periods()) -> DataFrame:
    """Missing rates, PSI, class and rank of every feature between two periods."""
    psi = union_all(
        psi_pooled_edges(df, numeric, periods).withColumn("feature_type", F.lit("numeric")),
        psi_categorical(df, categorical, periods).withColumn("feature_type", F.lit("categorical")),
    )
    table = psi.join(missing_by_period(df, [*numeric, *categorical], periods), "feature")
    classed = table.withColumn("drift_status", psi_class(F.col("psi"), PSI_LABELS_V4))
    keyed = classed.withColumn("_psi", F.round("psi", 9))
    return row_rank(keyed, "_psi", ["feature"], "rank").drop("_psi")


def feature_drift_moments(df: DataFrame, features: Sequence[str], periods: Periods = Periods()) -> DataFrame:
    """Means, deviations, changes, missing rates and PSI between two periods."""
    value = lambda c, within: F.when(within, F.col(c).cast("double"))
    missing = lambda c, within: F.avg(F.when(within, F.col(c).cast("double").isNull().cast("int")))
    table = _by_feature(
        df, features,
        {
            "reference_mean": lambda c: F.avg(value(c, periods.is_reference())),
            "current_mean": lambda c: F.avg(value(c, periods.is_current())),
            "reference_std": lambda c: F.stddev_samp(value(c, periods.is_reference())),
            "current_std": lambda c: F.stddev_samp(value(c, periods.is_current())),
            "reference_missing_rate": lambda c: missing(c, periods.is_reference()),
            "current_missing_rate": lambda c: missing(c, periods.is_current()),
        },
    )
    change = F.col("current_mean") - F.col("reference_mean")
    moved = table.withColumns(
        {"mean_change": change, "mean_change_pct": change / (F.abs("reference_mean") + 1e-9)}
    )
    return moved.join(psi_reference_edges(df, features, periods), "feature", "left").withColumn(
        "psi_status", psi_class(F.col("psi"), PSI_LABELS)
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts per class, the feature of largest PSI, and whether review is needed."""
    largest = F.max_by("feature", F.when(F.col("psi").isNotNull(), F.struct(F.round("psi", 9), F.col("feature"))))
    table = drift.agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if(F.col("drift_status") == "STABLE").alias("stable"),
        F.count_if(F.col("drift_status") == "MODERATE").alias("moderate"),
        F.count_if(F.col("drift_status") == "SIGNIFICANT").alias("significant"),
        F.max("psi").alias("maximum_psi"),
        largest.alias("maximum_psi_feature"),
    )
    return table.withColumn("production_readiness", F.when(F.col("significant") > 0, "REVIEW").otherwise("PASS"))


def _monitor(df: DataFrame, name: str, value: Column, status: Column, details: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("monitor"), value.cast("double").alias("value"), status.alias("status"), details.alias("details")
    )


def monitor_table(drift: DataFrame, probability: DataFrame, performance: DataFrame, recent: DataFrame) -> DataFrame:
    """One row per monitor: feature PSI, alert rate, F1, PR-AUC and recent changes."""
    psi = drift.agg(
        F.max("psi").alias("top"),
        F.count_if(F.col("psi") >= PSI_SIGNIFICANT).alias("significant"),
        F.count_if((F.col("psi") >= PSI_MODERATE) & (F.col("psi") < PSI_SIGNIFICANT)).alias("moderate"),
    )
    psi_status = (
        F.when(F.col("significant") > 0, "SIGNIFICANT_DRIFT").when(F.col("moderate") > 0, "MODERATE_DRIFT").otherwise("STABLE")
    )
    psi_details = F.concat(
        F.col("significant").cast("string"), F.lit(" significant, "), F.col("moderate").cast("string"), F.lit(" moderate")
    )
    threshold = F.concat(F.lit("Threshold="), F.format_number("policy_threshold", 2))
    is_baseline = F.col("period") == "BASELINE"
    change = recent.agg(
        *[
            (F.max(F.when(~is_baseline, F.col(c))) - F.max(F.when(is_baseline, F.col(c)))).alias(c)
            for c in ("event_rate", "alert_rate")
        ]
    )
    below = lambda c, limit: F.when(F.col(c) < limit, "REVIEW").otherwise("PASS")
    moved = lambda c, limit: F.when(F.abs(F.col(c)) > limit, "REVIEW").otherwise("STABLE")
    return union_all(
        _monitor(psi, "FEATURE_PSI", F.col("top"), psi_status, psi_details),
        _monitor(
            probability, "ALERT_RATE", F.col("alert_rate"),
            F.when(F.col("alert_rate") > 0.30, "HIGH_ALERT_RATE").otherwise("NORMAL"), threshold,
        ),
        _monitor(performance, "F1", F.col("f1"), below("f1", 0.15), F.lit("Policy performance")),
        _monitor(performance, "PR_AUC", F.col("pr_auc"), below("pr_auc", 0.10), F.lit("Ranking performance")),
        _monitor(change, "EVENT_RATE_CHANGE", F.col("event_rate"), moved("event_rate", 0.03), F.lit("Recent minus baseline")),
        _monitor(change, "ALERT_RATE_CHANGE", F.col("alert_rate"), moved("alert_rate", 0.10), F.lit("Recent minus baseline")),
    )


def monitoring_decision(monitors: DataFrame, threshold: float) -> DataFrame:
    """Whether to retrain, watch closely or carry on."""
    review = F.col("status").isin("REVIEW", "HIGH_ALERT_RATE", "MODERATE_DRIFT")
    table = monitors.agg(
        F.count_if(F.col("status") == "SIGNIFICANT_DRIFT").alias("significant_issues"),
        F.count_if(review).alias("review_items"),
    )
    decision = (
        F.when(F.col("significant_issues") > 0, "RETRAIN_OR_INVESTIGATE")
        .when(F.col("review_items") > 0, "MONITOR_CLOSELY")
        .otherwise("STABLE_FOR_CONTINUED_MONITORING")
    )
    return table.select(
        decision.alias("decision"), F.lit(float(threshold)).alias("policy_threshold"),
        "significant_issues", "review_items",
        F.when(F.col("review_items") > 0, "ATTENTION_REQUIRED").otherwise("STABLE").alias("monitoring_status"),
    )
