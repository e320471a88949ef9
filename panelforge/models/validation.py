"""Cross-validation, grid search, comparison and feature elimination.

The results are one row per fit, so they are small whatever the size of the data; the fits
themselves are Spark jobs over a table whose folds are fixed in a column beforehand. Linear models of
plain columns share one scan (``fold_statistics``), however many folds, penalties and steps there are.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.param import Param
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.models.ensemble import predict
from panelforge.models.fold_statistics import FoldStatistics, linear_terms
from panelforge.models.jobs import kept, side_by_side


def score_columns(label: str, prediction: str) -> dict[str, Column]:
    """Aggregates for the two scores: root mean squared error and R²."""
    y, error = F.col(label), F.col(label) - F.col(prediction)
    explained = F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))
    return {"rmse": F.sqrt(F.avg(error * error)), "r2": F.lit(1.0) - explained}


def fold_score(
    rows: DataFrame, estimator: Estimator, label: str, fold_col: str, fold: int, metric="rmse"
) -> float:
    """Fit on every other fold, score on this one."""
    model = estimator.fit(rows.filter(F.col(fold_col) != fold))
    scored = predict(model, rows.filter(F.col(fold_col) == fold), "_p")
    return scored.agg(score_columns(label, "_p")[metric].alias("score")).first()["score"]


def fold_scores(
    df: DataFrame,
    estimators: Sequence[Estimator],
    label: str,
    fold_col: str,
    folds: int,
    metric: str,
    threads: int = 4,
) -> list[list[float]]:
    """The score of every estimator on every fold."""
    terms = [linear_terms(e, df) for e in estimators]
    plain = [t for t in terms if t and t.label == label]
    found: list[list[float] | None] = [None] * len(estimators)
    if plain:
        columns = list(dict.fromkeys(c for t in plain for c in t.columns))
        statistics = FoldStatistics(df, columns, label, fold_col, folds)
        for k, t in enumerate(terms):
            if t in plain:
                found[k] = [statistics.score(t, i, metric) for i in range(folds)]
    others = [k for k, scores in enumerate(found) if scores is None]
    if others:
        with kept(df) as rows:
            tasks = [
                lambda k=k, i=i: fold_score(rows, estimators[k], label, fold_col, i, metric)
                for k in others
                for i in range(folds)
            ]
            scores = side_by_side(df.sparkSession, tasks, threads)
        for place, k in enumerate(others):
            found[k] = scores[place * folds : (place + 1) * folds]
    return found


def cross_validate(
    df: DataFrame,
    models: Mapping[str, Estimator],
    label: str,
    fold_col: str = "fold",
    folds: int = 5,
    threads: int = 4,
) -> DataFrame:
    """``(model, fold, rmse)`` for every model and fold."""
    found = fold_scores(df, list(models.values()), label, fold_col, folds, "rmse", threads)
    data = [(m, i, s) for m, scores in zip(models, found, strict=True) for i, s in enumerate(scores)]
    return df.sparkSession.createDataFrame(data, "model string, fold int, rmse double")


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores per model."""
    return scores.groupBy("model").agg(
        F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std")
    )


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: Sequence[Mapping[Param, Any]],
    label: str,
    fold_col: str = "fold",
    folds: int = 10,
    metric: str = "r2",
    name: str = "model",
    threads: int = 4,
) -> DataFrame:
    """``(model, params, score, best)`` for every parameter set: its mean score over the folds.

    Spark's own cross-validator checks a fold column with a row-wise Python function; fitting
    the parameter sets here keeps every row in the JVM.
    """
    candidates = [estimator.copy(dict(params)) for params in grid]
    found = fold_scores(df, candidates, label, fold_col, folds, metric, threads)
    means = [sum(scores) / folds for scores in found]
    first = means.index(max(means) if metric == "r2" else min(means))
    data = [
        (name, _params_text(p), float(s), int(i == first))
        for i, (p, s) in enumerate(zip(grid, means, strict=True))
    ]
    schema = "model string, params string, score double, best int"
    return df.sparkSession.createDataFrame(data, schema)


def _params_text(params: Mapping[Param, Any]) -> str:
    return json.dumps({p.name: v for p, v in params.items()}, sort_keys=True)


def param_grid(**axes: tuple[Param, Sequence]) -> list[dict[Param, Any]]:
    """Every combination of the given values, e.g. ``param_grid(n=(rf.numTrees, [10, 20]))``."""
    builder = ParamGridBuilder()
    for param, values in axes.values():
        builder = builder.addGrid(param, list(values))
    return builder.build()


def compare_models(
    df: DataFrame,
    candidates: Mapping[str, tuple[Estimator, Sequence[Mapping[Param, Any]]]],
    label: str,
    fold_col: str = "fold",
    folds: int = 10,
    metric: str = "r2",
) -> DataFrame:
    """Best parameters and score of each candidate, best first."""
    tables = []
    for name, (estimator, grid) in candidates.items():
        table = grid_search(df, estimator, grid, label, fold_col, folds, metric, name)
        tables.append(table.filter("best = 1").drop("best"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy(F.col("score").desc() if metric == "r2" else F.col("score"))


def importances(model) -> list[float]:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "featureImportances"):
        return [float(v) for v in last.featureImportances.toArray()]
    return [abs(float(v)) for v in last.coefficients.toArray()]


def _elimination_steps(features: Sequence[str], measure: Callable, least: int) -> list[list]:
    """One step per feature that goes; ``measure`` gives the fold scores and importances of some features."""
    left, steps = list(features), []
    while True:
        scores, weights = measure(list(left))
        steps.append([len(left), ",".join(left), None, sum(scores) / len(scores)])
        if len(left) <= least:
            return steps
        steps[-1][2] = left[min(range(len(left)), key=lambda i: (weights[i], i))]
        left.remove(steps[-1][2])


def eliminate_features(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    make: Callable[[list[str]], Estimator],
    fold_col: str = "fold",
    folds: int = 5,
    least: int = 1,
) -> DataFrame:
    """Drop the least important feature step by step; cross-validated error of every step.

    ``(n_features, features, dropped, rmse, selected)``; ``selected`` marks the step with the
    smallest error.
    """
    whole = linear_terms(make(list(features)), df)
    if whole and whole.label == label:
        statistics = FoldStatistics(df, features, label, fold_col, folds)

        def measure(names: list[str]) -> tuple[list[float], list[float]]:
            terms = linear_terms(make(names), df)
            scores = [statistics.score(terms, i) for i in range(folds)]
            return scores, [abs(float(w)) for w in statistics.weights(terms)]

        steps = _elimination_steps(features, measure, least)
    else:
        with kept(df) as rows:

            def measure(names: list[str]) -> tuple[list[float], list[float]]:
                estimator = make(names)
                tasks = [lambda i=i: fold_score(rows, estimator, label, fold_col, i) for i in range(folds)]
                scores = side_by_side(df.sparkSession, tasks)
                return scores, importances(estimator.fit(rows)) if len(names) > least else []

            steps = _elimination_steps(features, measure, least)
    best = min(range(len(steps)), key=lambda i: steps[i][3])
    data = [(*s, int(i == best)) for i, s in enumerate(steps)]
    schema = "n_features int, features string, dropped string, rmse double, selected int"
    return df.sparkSession.createDataFrame(data, schema)
