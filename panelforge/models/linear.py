"""Linear regressors whose penalties have the usual coordinate-descent meaning.

With ``n`` rows the objective is ``|y − Xw|² / 2n + alpha·rho·|w|₁ + alpha·(1 − rho)/2·|w|²``.
Spark divides the penalty by the label's deviation, so the quadratic part is multiplied by it
first; the absolute part needs no correction.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.models.scaling import QuartileScaler

# Fixed value: the widest feature vector for which Spark solves normal equations.
NORMAL_WIDTH = 4096


def label_spread(df: DataFrame, label: str, sample: bool = False) -> tuple[float, int]:
    """Deviation of the label and the number of rows."""
    deviation = F.stddev_samp(label) if sample else F.stddev_pop(label)
    row = df.agg(deviation.alias("s"), F.count(label).alias("n")).first()
    return float(row["s"] or 0.0), int(row["n"])


def vector_width(df: DataFrame, column: str) -> int:
    attributes = df.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in attributes:
        return int(attributes["num_attrs"])
    first = df.select(column).first()
    return first[0].size if first else 0


def solver_settings(width: int, normal_width: int = NORMAL_WIDTH) -> dict:
    """One pass for the normal equations while they fit on the driver, else iterated passes.

    The iterations of the normal solver run on the small equations, not on the data, so a tight
    tolerance costs nothing there. ``normal_width`` can only be lowered: beyond ``NORMAL_WIDTH``
    Spark refuses.
    """
    if width <= min(normal_width, NORMAL_WIDTH):
        return {"solver": "normal", "maxIter": 5000, "tol": 1e-12}
    return {"solver": "l-bfgs", "maxIter": 2000, "tol": 1e-8}


def converged(model):
    """The fitted linear model; an error if its iterations ended before they converged."""
    taken = model.summary.totalIterations if model.hasSummary else 0
    if model.getSolver() == "l-bfgs" and taken >= model.getMaxIter():
        raise RuntimeError(f"no convergence in {taken} iterations; scale the features or raise maxIter")
    return model


class PenalisedLinear(
    Estimator,
    HasFeaturesCol,
    HasLabelCol,
    HasPredictionCol,
    DefaultParamsReadable,
    DefaultParamsWritable,
):
    """Least squares with an absolute and a quadratic penalty on the features as they are."""

    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "absolute share", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        alpha=1.0,
        l1Ratio=1.0,
        featuresCol="features",
        labelCol="label",
        predictionCol="prediction",
    ):
        super().__init__()
        self._setDefault(alpha=1.0, l1Ratio=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        alpha, rho = self.getOrDefault(self.alpha), self.getOrDefault(self.l1Ratio)
        settings = solver_settings(vector_width(df, self.getFeaturesCol()))
        spread = 1.0
        if alpha and rho < 1.0:
            # the two solvers divide by different deviations of the label
            spread, _ = label_spread(df, self.getLabelCol(), settings["solver"] == "l-bfgs")
        absolute, quadratic = alpha * rho, alpha * (1.0 - rho) * spread
        strength = absolute + quadratic
        model = LinearRegression(
            featuresCol=self.getFeaturesCol(),
            labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(),
            regParam=strength,
            elasticNetParam=absolute / strength if strength else 0.0,
            standardization=False,
            **settings,
        ).fit(df)
        return converged(model)


def elastic_net(
    features: Sequence[str], label: str, alpha: float, l1_ratio: float
) -> Pipeline:
    """Robust scaling followed by an elastic net."""
    return Pipeline(
        stages=[
            QuartileScaler(inputCols=list(features), outputCol="features"),
            PenalisedLinear(alpha=float(alpha), l1Ratio=float(l1_ratio), labelCol=label),
        ]
    )


def lasso(features: Sequence[str], label: str, alpha: float) -> Pipeline:
    """Robust scaling followed by a lasso."""
    return elastic_net(features, label, alpha, 1.0)


# Share of the absolute penalty per penalty name.
PENALTIES = {"l2": 0.0, "elasticnet": 0.15, "l1": 1.0}


def sgd_linear(
    features: Sequence[str], label: str, penalty: str = "l2", alpha: float = 1e-4
) -> Pipeline:
    """Least squares with a named penalty, on the features as they are.

    The objective is the one a stochastic gradient solver approaches; Spark solves it outright,
    so there is no learning-rate schedule.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            PenalisedLinear(alpha=float(alpha), l1Ratio=PENALTIES[penalty], labelCol=label),
        ]
    )


class PolynomialRidge(
    Estimator, HasInputCols, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Ridge regression in the feature space of the kernel ``(gamma·xᵀz + coef0)^degree``.

    Degree 1 and 2 have short explicit feature maps, so the kernel's N×N system is never
    formed. The intercept is not penalised.
    """

    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    degree = Param(Params._dummy(), "degree", "1 or 2", TypeConverters.toInt)
    coef0 = Param(Params._dummy(), "coef0", "kernel constant", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel scale, 0 for 1/columns", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols=None,
        labelCol="label",
        predictionCol="prediction",
        alpha=0.6,
        degree=2,
        coef0=2.5,
        gamma=0.0,
    ):
        super().__init__()
        self._setDefault(alpha=0.6, degree=2, coef0=2.5, gamma=0.0)
        self._set(**self._input_kwargs)

    def map_weights(self, columns: int) -> list[float]:
        """Weight of each expanded term, in the order of Spark's polynomial expansion."""
        gamma = self.getOrDefault(self.gamma) or 1.0 / columns
        degree, coef0 = self.getOrDefault(self.degree), self.getOrDefault(self.coef0)
        if degree == 1:
            return [math.sqrt(gamma)] * columns
        if degree != 2:
            raise ValueError("degree must be 1 or 2")
        weights = []
        for i in range(columns):
            weights.append(math.sqrt(2.0 * gamma * coef0))
            weights += [math.sqrt(2.0) * gamma] * i + [gamma]
        return weights

    def _fit(self, df: DataFrame) -> PipelineModel:
        names = self.getInputCols()
        weights = Vectors.dense(self.map_weights(len(names)))
        settings = solver_settings(weights.size)
        spread, rows = label_spread(df, self.getLabelCol(), settings["solver"] == "l-bfgs")
        fitted = Pipeline(
            stages=[
                VectorAssembler(inputCols=names, outputCol="_raw"),
                PolynomialExpansion(
                    degree=self.getOrDefault(self.degree), inputCol="_raw", outputCol="_terms"
                ),
                ElementwiseProduct(scalingVec=weights, inputCol="_terms", outputCol="_mapped"),
                LinearRegression(
                    featuresCol="_mapped",
                    labelCol=self.getLabelCol(),
                    predictionCol=self.getPredictionCol(),
                    regParam=self.getOrDefault(self.alpha) / max(rows, 1) * spread,
                    elasticNetParam=0.0,
                    standardization=False,
                    **settings,
                ),
            ]
        ).fit(df)
        converged(fitted.stages[-1])
        return fitted
