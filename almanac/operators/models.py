"""Feature pipelines and classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.calendar import CALENDAR_B, normalize_month, season
from almanac.functions.levels import alert, inference_level
from almanac.functions.scalar import sigmoid
from almanac.operators.distribution import quantiles
from almanac.operators.joins import many_to_one
from almanac.operators.linear import LinearModel
from almanac.operators.metrics import ranking_metrics
from almanac.operators.ranking import order_rank
from almanac.session import stored, with_row
from almanac.spec import ScoreSpec


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Interpolated median of every column, as one row."""
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = numeric.unpivot([], list(columns), "feature", "value")
    medians = quantiles(long, ["feature"], "value", [0.5], bounded_keys=True).select("feature", F.col("quantiles")[0].alias("median"))
    return medians.groupBy().agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])


def impute_median(df: DataFrame, fit_df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the median of the fitting rows; 0 for a column without values."""
    names = {f"_m_{c}": c for c in columns}
    filled = with_row(df, column_medians(fit_df, columns), names)
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in columns}
    ).drop(*names)


def impute_mode(df: DataFrame, fit_df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls to the most frequent value of the fitting rows (smallest on ties)."""
    text = fit_df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    counts = text.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    # Rows of other features have no order and do not take part.
    order = F.struct(-F.col("n"), F.col("value"))
    modes = counts.agg(*[F.min_by("value", F.when(F.col("feature") == c, order)).alias(c) for c in columns])
    names = {f"_m_{c}": c for c in columns}
    return with_row(df, modes, names).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.col(f"_m_{c}")) for c in columns}
    ).drop(*names)


def numeric_stages(columns: Sequence[str], out: str = "numeric") -> list:
    """Assemble and standardise numeric columns."""
    return [
        VectorAssembler(inputCols=list(columns), outputCol=f"{out}_raw", handleInvalid="error"),
        StandardScaler(inputCol=f"{out}_raw", outputCol=out, withMean=True, withStd=True),
    ]


def categorical_stages(columns: Sequence[str]) -> list:
    """Index and one-hot encode; categories unseen in training encode to zeros."""
    indexed = [f"{c}_index" for c in columns]
    encoded = [f"{c}_onehot" for c in columns]
    return [
        StringIndexer(
            inputCols=list(columns), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=True),
    ]


def train_codes(train: DataFrame, columns: Sequence[str]) -> dict[str, DataFrame]:
    """A stored dictionary ``_value, <column>_code`` per column: codes in alphabetical order, learned on training rows only.

    The codes are ranks of the distinct values in ordered pieces, so a column may
    have any number of categories; none of them comes to the driver.
    """
    tables = {}
    for c in columns:
        values = train.select(F.col(c).cast("string").alias("_value")).where(F.col("_value").isNotNull()).distinct()
        ranked = order_rank(values, "_value", [], "_rank", descending=False)
        tables[c] = stored(ranked.select("_value", (F.col("_rank") - 1).cast("int").alias(f"{c}_code")), "codes")
    return tables


def apply_codes(df: DataFrame, codes: Mapping[str, DataFrame]) -> DataFrame:
    """Codes as integers; missing categories, and those unseen in training, have NULL.

    A small dictionary is broadcast by its measured size; beyond that the join lets
    adaptive execution split a hot category.
    """
    for c, table in codes.items():
        df = many_to_one(df.withColumn("_value", F.col(c).cast("string")), table, ["_value"]).drop("_value")
    return df


def closed_codes(domains: Mapping[str, Sequence[str]]) -> StringIndexerModel:
    """Codes of a closed domain; any other value is an error."""
    return StringIndexerModel.from_arrays_of_labels(
        [list(v) for v in domains.values()], list(domains), [f"{c}_code" for c in domains], handleInvalid="error"
    )


def balanced_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Weight n / (2 n_class), so that both classes weigh the same."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("q")
    )
    weights = counts.select(
        F.try_divide(F.col("n"), 2 * F.col("p")).alias("w1"), F.try_divide(F.col("n"), 2 * F.col("q")).alias("w0")
    )
    marked = with_row(df, weights, {"_w1": "w1", "_w0": "w0"})
    return marked.withColumn(out, F.when(F.col(target) == 1, F.col("_w1")).otherwise(F.col("_w0"))).drop("_w1", "_w0")


def positive_weight(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Weight negatives / positives on positive rows, 1 on the others."""
    counts = df.agg(
        F.try_divide(F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).alias("w")
    )
    marked = with_row(df, counts, {"_w": "w"})
    return marked.withColumn(out, F.when(F.col(target) == 1, F.coalesce("_w", F.lit(1.0))).otherwise(F.lit(1.0))).drop("_w")


def fit_logistic(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, max_iter: int = 100, reg: float = 0.0
) -> PipelineModel:
    """Class-balanced logistic regression over scaled numbers and one-hot categories."""
    weighted = balanced_weight(df, target)
    stages = [*numeric_stages(numeric)]
    inputs = ["numeric"]
    if categorical:
        stages += categorical_stages(categorical)
        inputs += [f"{c}_onehot" for c in categorical]
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol=target, weightCol="weight", maxIter=max_iter, regParam=reg,
            standardization=False,
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def fit_gbt(
    df: DataFrame,
    numeric: Sequence[str],
    coded: Sequence[str],
    target: str,
    params: Mapping | None = None,
    validation_col: str | None = None,
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees; rows marked by ``validation_col`` stop the boosting early."""
    settings = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, **(params or {})}
    weighted = positive_weight(df, target)
    booster = GBTClassifier(featuresCol="features", labelCol=target, weightCol="weight", seed=seed, **settings)
    if validation_col:
        booster = booster.setValidationIndicatorCol(validation_col)
    assembler = VectorAssembler(inputCols=[*numeric, *coded], outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, booster]).fit(weighted)


def add_probability(model: PipelineModel | LinearModel, df: DataFrame, out: str = "raw_probability") -> DataFrame:
    """Probability of the positive class, without the model's helper columns."""
    if isinstance(model, LinearModel):
        return df.withColumn(out, model.probability())
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def valid_policy(policy: DataFrame) -> DataFrame:
    """A policy table, raising unless it is one row of usable values."""
    facts = policy.agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("threshold").alias("threshold"),
        F.min("probability_type").alias("probability_type"),
    )
    t = F.col("threshold").try_cast("double")
    ok = (F.col("_n") == 1) & t.isNotNull() & ~F.isnan(t) & (t > 0) & (t < 1) & (F.col("probability_type") == "sigmoid_probability")
    refused = F.raise_error(F.lit("policy must be one row: sigmoid_probability with a threshold in (0, 1)")).cast("double")
    return facts.select("probability_type", F.when(F.coalesce(ok, F.lit(False)), t).otherwise(refused).alias("threshold"))


def prepare_rows(df: DataFrame, month: str = "month") -> DataFrame:
    """Month to a number and season forced to the one the month implies."""
    number = normalize_month(F.col(month))
    return df.withColumn("month_no", number).withColumn("season", season(number, CALENDAR_B))


def stamp(df: DataFrame, model_version: str, probability_type: str, target: str) -> DataFrame:
    """Who scored the row, when, and for what."""
    return df.withColumns(
        {
            "model_version": F.lit(model_version),
            "inference_timestamp_utc": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
            "probability_type": F.lit(probability_type),
            "target": F.lit(target),
        }
    )


def apply_policy(df: DataFrame, slope: Column | float, intercept: Column | float, threshold: Column | float) -> DataFrame:
    """Raw probability to calibrated probability, alert and level."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    calibrated = df.withColumns(
        {"sigmoid_probability": sigmoid(F.col("raw_probability"), slope, intercept), "policy_threshold": limit}
    )
    p, t = F.col("sigmoid_probability"), F.col("policy_threshold")
    return calibrated.withColumns({"risk_alert": alert(p, t).cast("boolean"), "risk_level": inference_level(p, t)})


def score_batch(
    model: PipelineModel | LinearModel, df: DataFrame, slope: Column | float, intercept: Column | float, policy: DataFrame, version: str, target: str
) -> DataFrame:
    """Score, calibrate, judge and stamp every row. The policy is checked first."""
    raw = add_probability(model, df)
    threshold = valid_policy(policy).select("threshold").scalar()
    return stamp(apply_policy(raw, slope, intercept, threshold), version, "sigmoid_probability", target)


def checked_predictions(scored: DataFrame) -> DataFrame:
    """Raise on a row whose probability, alert or level breaks the policy, when alert or level is used.

    The check sits on these two columns: as a filter it would be pushed below the
    scores and repeat their expressions many times over.
    """
    p, t = F.col("sigmoid_probability"), F.col("policy_threshold")
    ok = p.between(0, 1) & (F.col("risk_alert") == (p >= t)) & (F.col("risk_level") == inference_level(p, t))
    refused = F.raise_error(F.lit("inconsistent prediction"))
    sound = F.coalesce(ok, F.lit(False))
    return scored.withColumns({c: F.when(sound, F.col(c)).otherwise(refused.cast(scored.schema[c].dataType)) for c in ("risk_alert", "risk_level")})


def ablation(
    splits: DataFrame, experiments: Mapping[str, Sequence[str]], target: str, split: str = "split", max_iter: int = 50
) -> DataFrame:
    """Ranking quality on the test rows for the same learner on different features.

    One model per experiment (a handful); their scores are stacked, and all
    experiments are evaluated in one job.
    """
    train = splits.filter(F.col(split) == "TRAIN")
    test = splits.filter(F.col(split) == "TEST")
    stacked = None
    for name, features in experiments.items():
        model = fit_logistic(train, features, [], target, max_iter)
        scored = add_probability(model, test).select(
            F.lit(name).alias("experiment"), F.lit(len(features)).alias("feature_count"),
            F.col(target).alias("actual"), F.col("raw_probability").alias("probability"),
        )
        stacked = scored if stacked is None else stacked.unionByName(scored)
    return ranking_metrics(stacked, ScoreSpec(), ["experiment", "feature_count"])
