"""Reading and writing: panels, artifacts, policies, bundles, raw landing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.functions.calendar import MONTH_NAMES
from almanac.operators.calibration import SigmoidFit
from almanac.operators.clean import require_columns
from almanac.operators.linear import TERMS, LinearModel
from almanac.operators.models import valid_policy

# Yearly totals that follow the twelve months in the wide table.
SEASON_TOTALS = ["annual", "jf", "mam", "jjas", "ond"]


def wide_schema(entity: str = "subdivision", as_text: bool = False) -> T.StructType:
    """Entity, year, twelve months and five totals: 19 columns."""
    cell = T.StringType() if as_text else T.DoubleType()
    year = T.StringType() if as_text else T.IntegerType()
    months = [m.lower() for m in MONTH_NAMES]
    return T.StructType(
        [T.StructField(entity, T.StringType()), T.StructField("year", year)]
        + [T.StructField(c, cell) for c in [*months, *SEASON_TOTALS]]
    )


def policy_schema() -> T.StructType:
    return T.StructType(
        [T.StructField("target", T.StringType()), T.StructField("probability_type", T.StringType()), T.StructField("threshold", T.DoubleType())]
    )


def read_panel_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_panel(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Only the named columns; the reader never touches the others."""
    return require_columns(spark.read.format(fmt).load(path), columns).select(*columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a table; CSV gets a header."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_json_artifact(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


_FIT = "slope double, intercept double"


def save_model(model: PipelineModel, fit: SigmoidFit, path: str) -> None:
    """A fitted pipeline and its calibration, side by side: the pipeline in Spark's format, the curve as JSON."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    write_json_artifact(spark.createDataFrame([(fit.slope, fit.intercept)], _FIT).coalesce(1), f"{path}/calibration")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, SigmoidFit]:
    """What ``save_model`` wrote; scoring it gives the same numbers as before."""
    row = spark.read.schema(_FIT).json(f"{path}/calibration").first()
    if row is None:
        raise ValueError(f"no calibration in {path}")
    return PipelineModel.load(f"{path}/pipeline"), SigmoidFit(row["slope"], row["intercept"])


def save_linear(model: LinearModel, fit: SigmoidFit, path: str) -> None:
    """A linear model as a table of its terms, with its calibration as JSON."""
    spark = SparkSession.active()
    model.table(spark).write.mode("overwrite").parquet(f"{path}/terms")
    write_json_artifact(spark.createDataFrame([(fit.slope, fit.intercept)], _FIT).coalesce(1), f"{path}/calibration")


def load_linear(spark: SparkSession, path: str) -> tuple[LinearModel, SigmoidFit]:
    """What ``save_linear`` wrote."""
    row = spark.read.schema(_FIT).json(f"{path}/calibration").first()
    if row is None:
        raise ValueError(f"no calibration in {path}")
    return LinearModel.from_table(spark.read.schema(TERMS).parquet(f"{path}/terms")), SigmoidFit(row["slope"], row["intercept"])


def load_policy(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The one-row policy; anything else raises when it is used."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).schema(policy_schema())
    return valid_policy(reader.load(path))


def write_bundle(tables: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    """A report of many tables: one folder per table."""
    for name, table in tables.items():
        write_table(table, f"{directory.rstrip('/')}/{name}", fmt)


def land_raw(df: DataFrame, path: str, source_url: str, fmt: str = "parquet") -> None:
    """Append raw rows with their file, their source and the time of ingestion."""
    with_provenance(df, source_url).write.mode("append").format(fmt).save(path)


def with_provenance(df: DataFrame, source_url: str) -> DataFrame:
    return df.withColumns(
        {
            "source_file": F.input_file_name(),
            "source_url": F.lit(source_url),
            "ingestion_timestamp": F.current_timestamp(),
        }
    )
