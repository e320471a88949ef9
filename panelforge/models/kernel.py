"""Kernel ridge regression with a polynomial kernel of any degree, through Nystroem features.

The kernel between all rows is never formed. Rows are compared with a bounded number of landmarks; whitened by the
landmarks' own kernel, these values are features in which ridge regression is linear. With every row a landmark the
result is the exact solution for the positive part of the kernel. With a whole degree that is all of it; with a broken
one, directions with small negative values, which no features can express, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.models.linear import NORMAL_WIDTH, converged, label_spread, solver_settings

#: Directions of the landmarks' kernel below this share of the largest one are rounding errors.
_NOISE = 1e-13


def polynomial_kernel(x: np.ndarray, z: np.ndarray, gamma: float, coef0: float, degree: float) -> np.ndarray:
    """``(gamma·xᵀz + coef0)^degree`` of all rows of ``x`` and ``z``; below zero a broken degree gives 0."""
    base = gamma * (x @ z.T) + coef0
    return np.power(base if float(degree).is_integer() else np.maximum(base, 0.0), degree)


def whitening(kernel: np.ndarray) -> np.ndarray:
    """``m`` with ``mᵀ · kernel · m`` the identity, on the positive directions that are more than rounding errors."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    some = values > _NOISE * max(values.max(initial=0.0), 0.0)
    return vectors[:, some] / np.sqrt(values[some])


def _values(vector: Column, kind: str, fn) -> Column:
    """``fn`` of blocks of rows of a vector column, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            yield pd.Series(list(fn(x)) if kind != "double" else fn(x))

    return run(vector_to_array(vector))


class KernelRidge(Estimator, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    """Ridge regression under the kernel ``(gamma·xᵀz + coef0)^degree``, for degrees that need not be whole.

    ``landmarks`` distinct rows are drawn by a seeded hash of their values, or ``points`` names them. They are all that
    reaches the driver besides the normal equations, whose width they bound. The intercept is not penalised.
    A null or NaN in an input column is an error; a broken degree of a negative base counts as 0.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "degree, whole or broken", TypeConverters.toFloat)
    coef0 = Param(Params._dummy(), "coef0", "kernel constant", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel scale, 0 for 1/columns", TypeConverters.toFloat)
    landmarks = Param(Params._dummy(), "landmarks", "number of landmarks", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols=None,
        labelCol="label",
        predictionCol="prediction",
        alpha=0.6,
        degree=2.0,
        coef0=2.5,
        gamma=0.0,
        landmarks=256,
        seed=17,
        points: Sequence[Sequence[float]] | None = None,
    ):
        super().__init__()
        self._setDefault(alpha=0.6, degree=2.0, coef0=2.5, gamma=0.0, landmarks=256, seed=17)
        given = dict(self._input_kwargs)
        self.points = given.pop("points", None)
        self._set(**given)

    def _draw(self, rows: DataFrame) -> np.ndarray:
        if self.points is not None:
            return np.array(self.points, float)
        wanted = self.getOrDefault(self.landmarks)
        values = rows.select(vector_to_array("_x").alias("x"))
        order = F.xxhash64("x", F.lit(self.getSeed()))
        # a row's order is a function of its values, so copies are neighbours and one stays
        first = values.groupBy("x").agg(F.first(order).alias("o")).orderBy("o", "x").limit(wanted)
        return np.array([r["x"] for r in first.collect()], float)

    def _fit(self, df: DataFrame) -> KernelRidgeModel:
        names = self.getInputCols()
        if not 1 <= self.getOrDefault(self.landmarks) <= NORMAL_WIDTH:
            raise ValueError(f"landmarks must be 1 to {NORMAL_WIDTH}")
        gamma = self.getOrDefault(self.gamma) or 1.0 / len(names)
        shape = (gamma, self.getOrDefault(self.coef0), self.getOrDefault(self.degree))
        assembled = VectorAssembler(inputCols=names, outputCol="_x").transform(df)
        rows = assembled.select("_x", F.col(self.getLabelCol()).cast("double").alias("_y"))
        marks = self._draw(rows)
        if not len(marks):
            raise ValueError("no rows to learn from")
        among = polynomial_kernel(marks, marks, *shape)
        maps = whitening(among)
        # the intercept is free, so features may be counted from the landmarks' mean, which keeps their digits
        centre = (among @ maps).mean(axis=0)
        mapped = _values(F.col("_x"), "array<double>", lambda x: polynomial_kernel(x, marks, *shape) @ maps - centre)
        spread, count = label_spread(rows, "_y")
        model = converged(
            LinearRegression(
                featuresCol="_phi",
                labelCol="_y",
                regParam=self.getOrDefault(self.alpha) / max(count, 1) * spread,
                elasticNetParam=0.0,
                standardization=False,
                **solver_settings(maps.shape[1]),
            ).fit(rows.select("_y", array_to_vector(mapped).alias("_phi")))
        )
        found = model.coefficients.toArray()
        return self._copyValues(KernelRidgeModel(marks, maps @ found, float(model.intercept - centre @ found), shape))


class KernelRidgeModel(Model, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    def __init__(self, marks=None, weights=None, intercept: float = 0.0, shape=(1.0, 0.0, 1.0)):
        super().__init__()
        self.marks, self.weights, self.intercept, self.shape = marks, weights, intercept, shape

    def _transform(self, df: DataFrame) -> DataFrame:
        marks, weights, intercept, shape = self.marks, self.weights, self.intercept, self.shape
        scored = VectorAssembler(inputCols=self.getInputCols(), outputCol="_x").transform(df)
        value = _values(F.col("_x"), "double", lambda x: polynomial_kernel(x, marks, *shape) @ weights + intercept)
        return scored.select(*df.columns, value.alias(self.getPredictionCol()))
