"""A linear model as plain numbers: scored, explained and stored without the library that fitted it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.scalar import sigmoid

TERMS = "kind string, name string, level string, weight double, mean double, scale double"


@dataclass(frozen=True)
class LinearModel:
    """``intercept`` + sum of weight * (x - mean) / scale + the weight of each category.

    A column expression without vectors, so scoring stays in generated code and
    streams as it is. A category without a weight adds nothing.
    """

    intercept: float
    numeric: Mapping[str, tuple[float, float, float]]
    categories: Mapping[str, Mapping[str, float]] = field(default_factory=dict)

    def contribution(self, name: str) -> Column:
        weight, mean, scale = self.numeric[name]
        return F.lit(weight) * ((F.col(name).cast("double") - F.lit(mean)) / F.lit(scale))

    def margin(self) -> Column:
        terms = [self.contribution(name) for name in self.numeric]
        for name, weights in self.categories.items():
            levels = F.create_map(*[F.lit(x) for level, w in weights.items() for x in (level, float(w))])
            terms.append(F.coalesce(F.element_at(levels, F.col(name).cast("string")), F.lit(0.0)))
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return sigmoid(self.margin(), 1.0, 0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per term, for storage and reports."""
        rows: list[tuple] = [("intercept", "", None, float(self.intercept), 0.0, 1.0)]
        rows += [("numeric", name, None, *map(float, parts)) for name, parts in self.numeric.items()]
        rows += [("category", name, level, float(w), 0.0, 1.0) for name, weights in self.categories.items() for level, w in weights.items()]
        return spark.createDataFrame(rows, TERMS).coalesce(1)

    @staticmethod
    def from_table(df: DataFrame) -> LinearModel:
        """What ``table`` gave: as many rows as the model has terms."""
        rows = df.collect()
        starts = [r["weight"] for r in rows if r["kind"] == "intercept"]
        if len(starts) != 1:
            raise ValueError("a linear model has one intercept")
        categories: dict[str, dict[str, float]] = {}
        for r in rows:
            if r["kind"] == "category":
                categories.setdefault(r["name"], {})[r["level"]] = r["weight"]
        numeric = {r["name"]: (r["weight"], r["mean"], r["scale"]) for r in rows if r["kind"] == "numeric"}
        return LinearModel(starts[0], numeric, categories)

    @staticmethod
    def from_pipeline(model: PipelineModel, numeric: list[str], categorical: list[str] = ()) -> LinearModel:
        """The numbers of a pipeline made by ``fit_logistic``."""
        scaler, fitted = model.stages[1], model.stages[-1]
        weights = fitted.coefficients.toArray().tolist()
        means, scales = scaler.mean.toArray().tolist(), scaler.std.toArray().tolist()
        # A constant column is scaled to 0 and so adds nothing.
        parts = {c: (w if s > 0 else 0.0, m, s if s > 0 else 1.0) for c, w, m, s in zip(numeric, weights, means, scales)}
        rest, categories = weights[len(numeric) :], {}
        if categorical:
            for column, labels in zip(categorical, model.stages[2].labelsArray):
                # Index and encoder keep one place each for levels that were not seen; the encoder drops its own.
                categories[column], rest = dict(zip(labels, rest)), rest[len(labels) + 1 :]
        return LinearModel(float(fitted.intercept), parts, categories)
