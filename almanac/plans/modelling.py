"""Train, calibrate, choose a policy and score, on a dataset with time splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.operators import calibration, models, policy
from almanac.operators.splits import split_by_years
from almanac.operators.sweep import GRID_V4, Grid, threshold_sweep
from almanac.spec import ScoreSpec

PROBABILITIES = ["raw_probability", "isotonic_probability", "sigmoid_probability"]
CALIBRATED = ["isotonic_probability", "sigmoid_probability"]


def prepared_splits(dataset: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Year splits with medians of the training rows filled in."""
    split = split_by_years(dataset)
    return models.impute_median(split, split.filter(F.col("split") == "TRAIN"), numeric)


def calibrated_scores(model: PipelineModel, splits: DataFrame, target: str) -> DataFrame:
    """All rows with raw, isotonic and sigmoid probability; curves fit on validation."""
    scored = models.add_probability(model, splits).withColumn("actual", F.col(target))
    raw = ScoreSpec(probability="raw_probability")
    held_out = scored.filter(F.col("split") == "VALIDATION")
    curve = calibration.fit_sigmoid(held_out, raw)
    isotonic = calibration.fit_isotonic(held_out, raw)
    return calibration.apply_isotonic(
        scored.withColumn("sigmoid_probability", curve.apply(F.col("raw_probability"))), isotonic, "raw_probability"
    )


def choose_policy(select_df: DataFrame, grid: Grid = GRID_V4) -> DataFrame:
    """The two-tier policy of the best calibrated probability, on the given rows."""
    table, score = policy.probability_table(select_df, "actual", PROBABILITIES)
    quality = policy.compare_quality(table, score)
    sweep = threshold_sweep(table, score, grid, ["probability_type"])
    selected = policy.select_two_tier(sweep, partition=["probability_type"])
    return policy.final_policy(quality, selected, CALIBRATED)
