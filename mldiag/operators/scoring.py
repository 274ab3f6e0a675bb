"""Scorers: anything that turns feature columns into class probabilities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mldiag.functions.columns import (
    argmax_name,
    cosine_distance,
    doubles,
    euclidean,
    literal_matrix,
    ref,
)


class Scorer:
    """`transform` appends `probability` (array, in the order of `classes`) and `prediction`."""

    features: Sequence[str]
    classes: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class ExprScorer(Scorer):
    """A model given as a column expression: `fn` maps feature columns to a probability array.

    It stays in the JVM, and can be evaluated inside array functions at changed feature values.
    """

    features: Sequence[str]
    classes: Sequence[str]
    fn: Callable[[Sequence[Column]], Column]

    def probability(self, values: Sequence[Column]) -> Column:
        return self.fn(values)

    def transform(self, df: DataFrame) -> DataFrame:
        scored = df.withColumn("probability", self.fn([ref(f).cast("double") for f in self.features]))
        return scored.withColumn("prediction", argmax_name(F.col("probability"), self.classes))


class LinearScorer(ExprScorer):
    """Logistic model with given weights; two classes."""

    def __init__(
        self,
        features: Sequence[str],
        weights: Sequence[float],
        bias: float = 0.0,
        classes: Sequence[str] = ("0", "1"),
    ):
        self.weights, self.bias = [float(w) for w in weights], float(bias)
        super().__init__(features, classes, self._probability)

    def margin(self, values: Sequence[Column]) -> Column:
        total = F.lit(self.bias)
        for weight, value in zip(self.weights, values):
            total = total + F.lit(weight) * value
        return total

    def _probability(self, values: Sequence[Column]) -> Column:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(values)))
        return F.array(F.lit(1.0) - p, p)


@dataclass
class CentroidScorer(Scorer):
    """Nearest class centroid on an embedding; probabilities are a softmax of minus the distance."""

    vector: str
    classes: Sequence[str]
    centroids: Sequence[Sequence[float]]
    metric: str = "euclidean"
    digits: int | None = None

    @property
    def features(self) -> Sequence[str]:
        return [self.vector]

    @classmethod
    def fit(
        cls, df: DataFrame, vector: str, label: str, n_dims: int, metric: str = "euclidean",
        digits: int | None = None,
    ) -> "CentroidScorer":
        """One aggregation; the model (classes x dimensions numbers) is collected as its parameters."""
        means = [F.avg(F.get(ref(vector), F.lit(i)).cast("double")) for i in range(n_dims)]
        rows = (
            df.where(ref(label).isNotNull())
            .groupBy(ref(label).cast("string").alias("class"))
            .agg(F.array(*means).alias("centroid"))
            .orderBy("class")
            .collect()
        )
        return cls(vector, [r["class"] for r in rows], [r["centroid"] for r in rows], metric, digits)

    def transform(self, df: DataFrame) -> DataFrame:
        measure = euclidean if self.metric == "euclidean" else cosine_distance
        point = doubles(ref(self.vector))
        scored = df.withColumn(
            "_d", F.transform(literal_matrix(self.centroids), lambda c: measure(point, c))
        ).withColumn("_e", F.transform("_d", lambda d: F.exp(-d)))
        total = F.aggregate("_e", F.lit(0.0), lambda s, e: s + e)
        scored = scored.withColumn("_t", total)
        rounded = lambda p: p if self.digits is None else F.round(p, self.digits)
        return (
            scored.withColumn("probability", F.transform("_e", lambda e: rounded(e / F.col("_t"))))
            .withColumn(
                "prediction",
                F.element_at(
                    F.array(*[F.lit(c) for c in self.classes]),
                    F.array_position("_d", F.array_min("_d")).cast("int"),
                ),
            )
            .drop("_d", "_e", "_t")
        )


@dataclass
class BatchScorer(Scorer):
    """A model as a plain function on matrices: rows x features in, rows x classes out."""

    features: Sequence[str]
    classes: Sequence[str]
    fn: Callable[[np.ndarray], np.ndarray]

    def transform(self, df: DataFrame) -> DataFrame:
        fn = self.fn

        @F.pandas_udf("array<double>")
        def score(rows: pd.Series) -> pd.Series:
            matrix = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.empty((0, 0))
            return pd.Series(list(np.asarray(fn(matrix), dtype=float))) if len(rows) else pd.Series([])

        vector = F.array(*[ref(f).cast("double") for f in self.features])
        scored = df.withColumn("probability", score(vector))
        return scored.withColumn("prediction", argmax_name(F.col("probability"), self.classes))


@dataclass
class ModelScorer(Scorer):
    """A fitted ML pipeline. `labels` maps prediction index to class name, in probability order."""

    model: Any
    features: Sequence[str]
    classes: Sequence[str]
    probability_fn: Callable[[Column], Column] | None = None
    probability_col: str = "probability"

    def transform(self, df: DataFrame) -> DataFrame:
        helper = {"rawPrediction", "_features", "_label", "probability", "prediction", "_rff"}
        clash = [c for c in df.columns if c in helper]
        scored = self.model.transform(df.drop(*clash))
        values = vector_to_array(F.col(self.probability_col))
        if self.probability_fn is not None:
            values = self.probability_fn(values)
        names = F.array(*[F.lit(c) for c in self.classes])
        keep = [ref(c) for c in df.columns if c not in clash]
        return scored.select(
            *keep,
            values.alias("probability"),
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"),
        )


def decision_surface(
    df: DataFrame, scorer: ExprScorer, resolution: int = 200
) -> DataFrame:
    """(i, j, x, y, value): largest class probability on a mesh over the padded 2-D extent."""
    x, y = scorer.features
    span = df.agg(
        *[
            fn(ref(c)).cast("double").alias(name)
            for c, names in ((x, ("x0", "x1")), (y, ("y0", "y1")))
            for fn, name in zip((F.min, F.max), names)
        ]
    )
    pad_x, pad_y = (F.col("x1") - F.col("x0")) * 0.1, (F.col("y1") - F.col("y0")) * 0.1
    span = span.select(
        (F.col("x0") - pad_x).alias("x0"),
        (F.col("x1") + pad_x).alias("x1"),
        (F.col("y0") - pad_y).alias("y0"),
        (F.col("y1") + pad_y).alias("y1"),
    )
    # one row of extents, unfolded to resolution x resolution mesh points
    mesh = span.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(resolution * resolution - 1))).alias("cell")
    ).withColumns(
        {"i": F.floor(F.col("cell") / resolution), "j": F.col("cell") % resolution}
    )
    mesh = mesh.select(
        "i",
        "j",
        (F.col("x0") + F.col("j") * (F.col("x1") - F.col("x0")) / (resolution - 1)).alias("x"),
        (F.col("y0") + F.col("i") * (F.col("y1") - F.col("y0")) / (resolution - 1)).alias("y"),
    )
    value = F.array_max(scorer.probability([F.col("x"), F.col("y")]))
    return mesh.select(
        "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(value, 6).alias("value")
    )
