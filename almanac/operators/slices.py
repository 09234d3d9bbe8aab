"""Report tables over slices of a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.calendar import period_thirds, valid_month
from almanac.functions.levels import DEPLOYMENT_ORDER, deployment_level
from almanac.functions.scalar import flag, rate
from almanac.operators.distribution import even_steps, quantile_columns, quantiles
from almanac.operators.joins import null_safe_join, union_all
from almanac.operators.metrics import COUNTS, binary_metrics, confusion_aggregates, mean, metrics_by, score_table, tally
from almanac.operators.ranking import dense_rank_by
from almanac.session import with_row
from almanac.spec import ScoreSpec

# Probability bands, left-closed; the last is open above.
PROBABILITY_BANDS = [
    ("VERY_LOW_<2%", 0.00, 0.02),
    ("LOW_2-5%", 0.02, 0.05),
    ("MODERATE_5-10%", 0.05, 0.10),
    ("ELEVATED_10-15%", 0.10, 0.15),
    ("HIGH_15-20%", 0.15, 0.20),
    ("CRITICAL_>=20%", 0.20, None),
]

# Edges of the probability error bins, left-closed.
ERROR_BIN_EDGES = [0.00, 0.02, 0.04, 0.06, 0.08, 0.09, 0.10, 0.12, 0.15, 0.20, 0.30, 0.50, 0.70, 1.01]

# Fixed value: slices with fewer rows carry a warning.
MIN_GROUP_SIZE = 20


def event_rate_by(df: DataFrame, level: str, actual: str) -> DataFrame:
    """Observations, events and event rate per level."""
    table = df.groupBy(level).agg(F.count(actual).alias("observations"), F.sum(actual).alias("events"))
    return table.withColumn("event_rate", rate(F.col("events"), F.col("observations")))


def regional_alert_summary(df: DataFrame, score: ScoreSpec, threshold: float) -> DataFrame:
    """Events, alerts and probabilities per region with the derived rates."""
    p = F.col(score.probability)
    table = df.groupBy(score.region).agg(
        F.count(score.actual).alias("observations"),
        F.sum(score.actual).alias("actual_events"),
        F.avg(p).alias("average_probability"),
        F.max(p).alias("maximum_probability"),
        F.sum(flag(p >= threshold)).alias("alerts"),
    )
    return table.withColumns(
        {
            "actual_event_rate": rate(F.col("actual_events"), F.col("observations")),
            "alert_rate": rate(F.col("alerts"), F.col("observations")),
        }
    )


def slice_summary(df: DataFrame, score: ScoreSpec, threshold: float, by: str, rank: bool = False) -> DataFrame:
    """Metrics per slice, optionally dense-ranked by average probability."""
    table = metrics_by(df, score, threshold, [by]).select(
        by, "observations", "events", "event_rate", "alerts", "alert_rate",
        "average_probability", "maximum_probability", "precision", "recall", "f1",
    )
    return dense_rank_by(table, "average_probability") if rank else table


def monitored_slices(df: DataFrame, score: ScoreSpec, threshold: float, by: str) -> DataFrame:
    """Slice metrics with ranking quality and a warning for small slices."""
    table = metrics_by(df, score, threshold, [by], ranking=True).drop("minimum_probability")
    return table.withColumn("sample_warning", F.when(F.col("observations") < MIN_GROUP_SIZE, "SMALL_SAMPLE").otherwise(""))


def stacked_slices(df: DataFrame, score: ScoreSpec, threshold: float, slices: dict[str, str]) -> DataFrame:
    """Metrics for many slice columns in one table, told apart by ``analysis_type``.

    ``slices`` maps a type to its column. Rows are first reduced to one per
    combination of slice values, and only those go through the grouping sets.
    """
    columns = list(slices.values())
    p = F.col(score.probability)
    alerted = F.coalesce(p >= threshold, F.lit(False))
    cells = df.groupBy(*columns).agg(
        *confusion_aggregates(score, alerted),
        F.sum(p).alias("_sum"), F.count(p).alias("_n"), F.max(p).alias("_max"),
    )
    kind = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(t)) for t, c in slices.items()])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    counts = cells.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        kind.alias("analysis_type"), value.alias("slice"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"), F.max("_max").alias("maximum_probability"),
    )
    table = binary_metrics(counts).withColumn("average_probability", F.try_divide(F.col("_sum"), F.col("_n")))
    return table.drop("_sum", "_n", *columns)


def reliability(df: DataFrame, score: ScoreSpec, bins: int = 10) -> DataFrame:
    """Observed rate against mean probability per score decile.

    Bins are right-closed between distinct quantiles; the first also holds the
    minimum. Repeated quantiles merge into one bin. Edges and bins come from one
    score table, so the facts are scanned once.
    """
    df, score = score_table(df, score)
    edges = quantiles(df, [], score.probability, even_steps(bins), weight=score.weight)
    unique = edges.select(F.array_distinct("quantiles").alias("edges"))
    placed = with_row(df.filter(F.col(score.probability).isNotNull()), unique, {"_edges": "edges"})
    position = F.lit(0)
    for i in range(bins + 1):
        edge = F.get(F.col("_edges"), F.lit(i))
        position = position + flag(edge < F.col(score.probability))
    table = placed.groupBy(F.greatest(position, F.lit(1)).alias("bin")).agg(
        tally(score).alias("observations"),
        tally(score, F.col(score.actual) == 1).alias("events"),
        mean(score, F.col(score.probability)).alias("mean_probability"),
        F.min(score.probability).alias("minimum_probability"),
        F.max(score.probability).alias("maximum_probability"),
    )
    return table.withColumn("actual_event_rate", rate(F.col("events"), F.col("observations")))


def probability_bands(df: DataFrame, score: ScoreSpec, bands: Sequence[tuple] = tuple(PROBABILITY_BANDS)) -> DataFrame:
    """Event rate against mean probability per band; empty bands are left out."""
    p = F.col(score.probability)
    label = F.lit(None).cast("string")
    for name, lower, upper in reversed(bands):
        inside = p >= lower if upper is None else (p >= lower) & (p < upper)
        label = F.when(inside, name).otherwise(label)
    table = df.groupBy(label.alias("probability_band")).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(score.actual).alias("events"),
        F.avg(score.actual).alias("actual_event_rate"),
        F.avg(p).alias("mean_predicted_probability"),
    )
    gap = F.abs(F.col("actual_event_rate") - F.col("mean_predicted_probability"))
    return table.filter(F.col("probability_band").isNotNull()).withColumn("calibration_gap", gap)


def _bin_label(lower: float, upper: float) -> str:
    return f"{lower:.2f}+" if upper > 1 else f"{lower:.2f}-{upper:.2f}"


def probability_bins(
    df: DataFrame, score: ScoreSpec, threshold: float, edges: Sequence[float] = tuple(ERROR_BIN_EDGES), keep_empty: bool = True
) -> DataFrame:
    """Errors per probability bin; bins without rows stay with zero counts."""
    spark = df.sparkSession
    labels = [_bin_label(lo, hi) for lo, hi in zip(edges, edges[1:])]
    p, y = F.col(score.probability), F.col(score.actual)
    label = F.lit(None).cast("string")
    for name, lower, upper in zip(labels, edges, edges[1:]):
        label = F.when((p >= lower) & (p < upper), name).otherwise(label)
    alerted = F.coalesce(p >= threshold, F.lit(False))
    counted = df.groupBy(label.alias("probability_bin")).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(y).alias("events"),
        F.avg(y).alias("actual_event_rate"),
        F.count_if(alerted).alias("alerts"),
        F.avg(p).alias("average_probability"),
        F.count_if((y == 0) & alerted).alias("false_positives"),
        F.count_if((y == 1) & ~alerted).alias("false_negatives"),
    )
    counted = counted.withColumn("alert_rate", F.try_divide(F.col("alerts"), F.col("observations")))
    if not keep_empty:
        return counted.filter(F.col("probability_bin").isNotNull())
    every = spark.createDataFrame([(name,) for name in labels], "probability_bin string")
    filled = every.join(counted, "probability_bin", "left")
    return filled.na.fill(0, ["observations", "events", "alerts", "false_positives", "false_negatives"])


def risk_distribution(df: DataFrame, score: ScoreSpec) -> DataFrame:
    """Rows, events and mean probability per risk level, in level order."""
    labelled = df.withColumn("risk_level", deployment_level(F.col(score.probability)))
    table = labelled.groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(score.actual).alias("events"),
        F.avg(score.actual).alias("event_rate"),
        F.avg(score.probability).alias("average_probability"),
    )
    position = F.array_position(F.array(*[F.lit(name) for name in DEPLOYMENT_ORDER]), F.col("risk_level"))
    total = F.sum("observations").over(Window.partitionBy(F.lit(0)))
    return table.withColumns(
        {"level_order": position.cast("int"), "percentage": rate(F.col("observations"), total)}
    ).orderBy("level_order")


def probability_summary(df: DataFrame, score: ScoreSpec, threshold: float) -> DataFrame:
    """One row that describes the distribution of the probabilities and alerts, from one scan."""
    df, score = score_table(df, score)
    p = F.col(score.probability)
    # Deviations are summed around the mean itself, not as a difference of large sums.
    centred = with_row(df, df.agg(mean(score, p).alias("m")), {"_m": "m"})
    gap, known = p - F.col("_m"), tally(score, p.isNotNull())
    moments = centred.agg(
        tally(score).alias("observations"),
        mean(score, p).alias("mean_probability"),
        F.when(known > 1, F.sqrt(F.sum(gap * gap * F.col(score.weight)) / (known - 1))).alias("std_probability"),
        F.min(p).alias("minimum_probability"),
        F.max(p).alias("maximum_probability"),
        F.lit(float(threshold)).alias("policy_threshold"),
        tally(score, p >= threshold).alias("alerts"),
    ).withColumn("alert_rate", rate(F.col("alerts"), F.col("observations")))
    points = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    spread = quantile_columns(df, [], score.probability, {f"{k}_probability": q for k, q in points.items()}, weight=score.weight)
    return with_row(moments, spread, {f"{k}_probability": f"{k}_probability" for k in points})


def alert_stability(df: DataFrame, score: ScoreSpec, threshold: float, by: str = "year") -> DataFrame:
    """Alerts and probability level per year (or another slice), from one scan."""
    df, score = score_table(df, score, [by])
    p = F.col(score.probability)
    table = df.groupBy(by).agg(
        tally(score).alias("observations"),
        tally(score, p >= threshold).alias("alerts"),
        mean(score, p).alias("mean_probability"),
        F.max(p).alias("maximum_probability"),
    ).withColumn("alert_rate", rate(F.col("alerts"), F.col("observations")))
    few = by in (score.year, score.month, score.season)
    p95 = quantile_columns(df, [by], score.probability, {"p95_probability": 0.95}, bounded_keys=few, weight=score.weight).drop("n")
    return null_safe_join(table, p95, [by], "left")


def target_drift(df: DataFrame, score: ScoreSpec, threshold: float, by: str = "year") -> DataFrame:
    """Event rate per year against the rate over all rows."""
    p = F.col(score.probability)
    table = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sum(score.actual).alias("events"),
        F.avg(p).alias("mean_probability"),
        F.avg(flag(p >= threshold)).alias("alert_rate"),
    ).withColumn("event_rate", rate(F.col("events"), F.col("observations")))
    # The years' own counts add up to the global rate: no second scan.
    everything = Window.partitionBy(F.lit(0))
    overall = F.sum("events").over(everything) / F.sum("observations").over(everything)
    return table.withColumn("_global", overall).withColumns(
        {
            "event_rate_vs_global": F.col("event_rate") / (F.col("_global") + 1e-12),
            "absolute_event_rate_change": F.col("event_rate") - F.col("_global"),
        }
    ).drop("_global")


def label_recent(df: DataFrame, year: str = "year", out: str = "period") -> DataFrame:
    """BASELINE for all years before the latest, RECENT_<year> for the latest."""
    latest = with_row(df, df.agg(F.max(year).alias("latest")), {"_latest": "latest"})
    recent = F.concat(F.lit("RECENT_"), F.col("_latest").cast("string"))
    return latest.withColumn(out, F.when(F.col(year) == F.col("_latest"), recent).otherwise("BASELINE")).drop("_latest")


def recent_vs_baseline(df: DataFrame, score: ScoreSpec, threshold: float) -> DataFrame:
    """All metrics for the latest year and for all earlier years, from one scan."""
    df, score = score_table(df, score, [score.year])
    labelled = label_recent(df.filter(F.col(score.year).isNotNull()), score.year)
    table = metrics_by(labelled, score, threshold, ["period"], ranking=True)
    return table.select(
        "period", "observations", "event_rate", F.col("average_probability").alias("mean_probability"), "alert_rate",
        "precision", "recall", "f1", "pr_auc", "roc_auc", "brier_score",
    )


def compare_periods(df: DataFrame, period: str, metrics: dict[str, str], baseline: str, recent: str) -> DataFrame:
    """Baseline, recent and difference of named aggregates, in one conditional pass."""
    table = df.groupBy().agg(
        *[F.avg(F.when(F.col(period) == baseline, F.col(c))).alias(f"baseline_{n}") for n, c in metrics.items()],
        *[F.avg(F.when(F.col(period) == recent, F.col(c))).alias(f"recent_{n}") for n, c in metrics.items()],
    )
    return table.withColumns({f"{n}_change": F.col(f"recent_{n}") - F.col(f"baseline_{n}") for n in metrics})


def unknown_month(df: DataFrame, score: ScoreSpec, threshold: float, month: str = "month") -> DataFrame:
    """One row about rows whose month is unusable; zeros when there are none."""
    p = F.col(score.probability)
    table = df.filter(~valid_month(F.col(month))).agg(
        F.count(F.lit(1)).alias("observations"),
        F.coalesce(F.sum(score.actual), F.lit(0)).alias("events"),
        F.coalesce(F.sum(flag(p >= threshold)), F.lit(0)).alias("alerts"),
        F.avg(p).alias("average_probability"),
        F.max(p).alias("maximum_probability"),
    )
    return table.withColumns(
        {
            "event_rate": rate(F.col("events"), F.col("observations")),
            "alert_rate": rate(F.col("alerts"), F.col("observations")),
        }
    )


def metrics_by_period(df: DataFrame, score: ScoreSpec, threshold: float) -> DataFrame:
    """Metrics for the early, middle and late third of the years."""
    return metrics_by(period_thirds(df, score.year), score, threshold, ["time_period"])


def stress_report(df: DataFrame, score: ScoreSpec, threshold: float, sweep: DataFrame) -> DataFrame:
    """Season, region, year and period slices, bands and thresholds as one table."""
    labelled = period_thirds(df, score.year)
    slices = stacked_slices(
        labelled, score, threshold,
        {"SEASON": score.season, "REGION": score.region, "YEAR": score.year, "TIME_PERIOD": "time_period"},
    )
    bands = probability_bands(df, score).withColumn("analysis_type", F.lit("PROBABILITY_BAND"))
    return union_all(slices, bands, sweep.withColumn("analysis_type", F.lit("THRESHOLD")), allow_missing=True)


def overall_performance(df: DataFrame, score: ScoreSpec, threshold: float) -> DataFrame:
    """All metrics over the whole table, one row."""
    return metrics_by(df, score, threshold, [], ranking=True)


