"""Streaming scoring: the batch checks and scoring on an unbounded table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from almanac.operators.calibration import SigmoidFit
from almanac.operators.linear import LinearModel
from almanac.operators.models import add_probability, apply_policy, checked_predictions, prepare_rows
from almanac.sources.io import load_policy


def reject_reason(df: DataFrame, numeric: Sequence[str], domains: Mapping[str, Sequence[str]]) -> Column:
    """Why a row cannot be scored, NULL when it can."""
    reason = F.lit(None).cast("string")
    for column, domain in reversed(list(domains.items())):
        outside = ~F.coalesce(F.col(column).isin(*domain), F.lit(False))
        reason = F.when(outside, F.lit(f"{column} outside its domain")).otherwise(reason)
    for column in reversed(list(numeric)):
        reason = F.when(F.col(column).isNull(), F.lit(f"{column} is missing")).otherwise(reason)
    return reason


def stream_score(
    stream: DataFrame, model: PipelineModel | LinearModel, slope: float, intercept: float, threshold: float,
    numeric: Sequence[str], domains: Mapping[str, Sequence[str]], month: str = "month",
) -> tuple[DataFrame, DataFrame]:
    """Scored rows and rejected rows of a stream. Stateless, so it needs no watermark.

    The season is forced to the one its month implies; rows with a missing number
    or a category outside its closed domain are rejected with the reason.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold of a policy lies in (0, 1)")
    marked = prepare_rows(stream, month).transform(lambda d: d.withColumn("reject_reason", reject_reason(d, numeric, domains)))
    good = marked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = marked.filter(F.col("reject_reason").isNotNull())
    return apply_policy(add_probability(model, good), slope, intercept, threshold), bad


@dataclass(frozen=True)
class StreamScorer:
    """Scores a stream with a stored model and curve, under the policy as it is when a micro-batch starts.

    The policy table is read and checked for every micro-batch: one row of usable
    values, or the batch fails and is run again later. Results are written per batch
    id, so a repeated batch replaces what it wrote.
    """

    path: str
    model: PipelineModel | LinearModel
    curve: SigmoidFit
    policy_path: str
    numeric: Sequence[str]
    domains: Mapping[str, Sequence[str]]

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Score one micro-batch."""
        policy = load_policy(batch.sparkSession, self.policy_path).first()
        good, bad = stream_score(batch, self.model, self.curve.slope, self.curve.intercept, policy["threshold"], self.numeric, self.domains)
        checked_predictions(good).write.mode("overwrite").parquet(f"{self.path}/scored/batch_id={batch_id}")
        bad.write.mode("overwrite").parquet(f"{self.path}/rejected/batch_id={batch_id}")

    def run(self, stream: DataFrame) -> None:
        """Score all available input, from where the last run ended."""
        query = (
            stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, exactly once, until the available input is used up."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
