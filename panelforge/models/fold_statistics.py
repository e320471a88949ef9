"""Penalised linear models of every fold, penalty and subset of columns from one scan.

Least squares sees the rows only through counts, means and centred products. Those of each fold come from one
aggregation; the folds a model trains on are merged, any penalty is solved on these small matrices, and the left-out
fold's own sums give its error. No fit reads the data again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from panelforge.models.linear import NORMAL_WIDTH, PenalisedLinear
from panelforge.operators.moments import pair_moments

_SWEEPS, _CLOSE = 100_000, 1e-13


@dataclass(frozen=True)
class LinearTerms:
    """What a linear estimator on plain columns is: its columns, label and penalties."""

    columns: tuple[str, ...]
    label: str
    alpha: float
    l1_ratio: float


def linear_terms(estimator: Estimator, df: DataFrame) -> LinearTerms | None:
    """The terms of a penalised linear model of numeric columns as they are; None for any other estimator.

    Scaled models are not among them: their quartiles belong to the rows they train on.
    """
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    if len(stages) != 2 or type(stages[0]) is not VectorAssembler or type(stages[1]) is not PenalisedLinear:
        return None
    assembler, linear = stages
    if assembler.getOutputCol() != linear.getFeaturesCol() or len(assembler.getInputCols()) >= NORMAL_WIDTH:
        return None
    if not all(isinstance(df.schema[c].dataType, NumericType | BooleanType) for c in assembler.getInputCols()):
        return None
    return LinearTerms(
        tuple(assembler.getInputCols()),
        linear.getLabelCol(),
        linear.getOrDefault(linear.alpha),
        linear.getOrDefault(linear.l1Ratio),
    )


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred products of some columns."""

    n: float
    means: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.means - self.means
        middle = np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.means + apart * (other.n / n), self.products + other.products + middle)

    def of(self, places: Sequence[int]) -> Moments:
        return Moments(self.n, self.means[places], self.products[np.ix_(places, places)])


def penalised_weights(moments: Moments, alpha: float, l1_ratio: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of the last column on the others.

    The minimum of ``|y - Xw - b|^2 / 2n + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) / 2 * |w|^2``, by coordinate
    descent with covariance updates; without an absolute penalty by one decomposition.
    """
    gram, target = moments.products[:-1, :-1] / moments.n, moments.products[:-1, -1] / moments.n
    absolute, ridge = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    if not absolute:
        weights = np.linalg.lstsq(gram + ridge * np.eye(len(gram)), target, rcond=1e-13)[0]
    else:
        weights, slope = np.zeros(len(gram)), target.copy()
        scale = np.sqrt(np.maximum(np.diag(gram), 0.0))
        for _ in range(_SWEEPS):
            moved = 0.0
            for j in np.flatnonzero(scale):
                pull = slope[j] + gram[j, j] * weights[j]
                new = np.sign(pull) * max(abs(pull) - absolute, 0.0) / (gram[j, j] + ridge)
                if new != weights[j]:
                    slope -= gram[:, j] * (new - weights[j])
                    moved = max(moved, abs(new - weights[j]) * scale[j])
                    weights[j] = new
            if moved <= _CLOSE * np.abs(weights * scale).max(initial=0.0):
                break
        else:
            raise RuntimeError(f"no convergence in {_SWEEPS} sweeps; scale the features")
    return weights, float(moments.means[-1] - weights @ moments.means[:-1])


class FoldStatistics:
    """The moments of ``columns`` and ``label`` in every fold, ``0 .. folds - 1``.

    Gaps raise an error, as they do in the fits this stands for. What reaches the driver is one matrix per fold,
    which the number of columns bounds.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], label: str, fold_col: str, folds: int):
        self.columns = list(columns)
        width = len(self.columns) + 1
        # a column without gaps counts the rows of a fold
        names = [*(f"v{k}" for k in range(width)), "every"]
        values = [F.col(f"`{c}`").alias(n) for c, n in zip([*self.columns, label], names, strict=False)]
        held = df.select(F.col(f"`{fold_col}`").alias("fold"), *values, F.lit(1).alias("every"))
        found = pair_moments(held.where(F.col("fold").between(0, folds - 1)), names, "fold").toArrow()
        table = {name: found.column(name).to_numpy() for name in found.column_names}
        self.folds = []
        for fold in range(folds):
            mine = table["g"] == fold
            n, means, products = table["n"][mine], np.zeros(width + 1), np.zeros((width + 1, width + 1))
            if len(n) and (len(n) < (width + 1) * (width + 2) // 2 or (n != n.max()).any()):
                raise ValueError("linear models take no gaps: fill or drop them first")
            i, j = table["i"][mine], table["j"][mine]
            # every column is the second of a pair with itself or one before it
            means[j] = table["mean_j"][mine]
            products[i, j] = products[j, i] = table["ss_ij"][mine]
            self.folds.append(Moments(float(n.max(initial=0.0)), means[:-1], products[:-1, :-1]))

    def without(self, fold: int | None = None) -> Moments:
        """The moments of all folds but one."""
        kept = [m for k, m in enumerate(self.folds) if k != fold]
        return sum(kept[1:], kept[0])

    def _places(self, terms: LinearTerms) -> list[int]:
        return [*(self.columns.index(c) for c in terms.columns), len(self.columns)]

    def weights(self, terms: LinearTerms) -> np.ndarray:
        """The weights of a model of all folds."""
        return penalised_weights(self.without().of(self._places(terms)), terms.alpha, terms.l1_ratio)[0]

    def score(self, terms: LinearTerms, fold: int, metric: str = "rmse") -> float | None:
        """The error on ``fold`` of the model of the others: ``rmse`` or ``r2`` (None where undefined)."""
        places = self._places(terms)
        weights, intercept = penalised_weights(self.without(fold).of(places), terms.alpha, terms.l1_ratio)
        held = self.folds[fold].of(places)
        if not held.n:
            return None
        residual = np.append(-weights, 1.0)
        off = held.means @ residual - intercept
        squares = max(float(residual @ held.products @ residual), 0.0) + held.n * off * off
        if metric == "rmse":
            return float(np.sqrt(squares / held.n))
        total = float(held.products[-1, -1])
        return 1.0 - squares / total if total else None
