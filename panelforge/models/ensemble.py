"""Averages, stacks and blends of regressors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.models.jobs import kept, side_by_side
from panelforge.operators.joins import union_all


def predict(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the model's prediction in ``name`` and no other new column."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    made = last.getPredictionCol() if last.hasParam("predictionCol") else "prediction"
    return model.transform(df).select(*df.columns, F.col(made).alias(name))


def mean_of(columns: Sequence[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(columns)))


def blend(df: DataFrame, weights: Mapping[str, float], name: str = "blend") -> DataFrame:
    """Weighted sum of prediction columns."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.col(c) * F.lit(float(w))
    return df.withColumn(name, total)


class AveragingRegressor(Estimator, HasLabelCol, HasPredictionCol):
    """The mean of several regressors fitted on the same rows."""

    def __init__(self, members: Sequence[Estimator], threads: int = 4):
        super().__init__()
        self.members, self.threads = list(members), threads

    def _fit(self, df: DataFrame) -> AveragingModel:
        with kept(df) as rows:
            tasks = [lambda m=m: m.fit(rows) for m in self.members]
            model = AveragingModel(side_by_side(df.sparkSession, tasks, self.threads))
        return self._copyValues(model)


class AveragingModel(Model, HasPredictionCol):
    def __init__(self, members=()):
        super().__init__()
        self.members = list(members)

    def _transform(self, df: DataFrame) -> DataFrame:
        names, scored = [], df
        for i, member in enumerate(self.members):
            names.append(f"_member_{i}")
            scored = predict(member, scored, names[-1])
        return scored.select(*df.columns, mean_of(names).alias(self.getPredictionCol()))


class StackingRegressor(Estimator, HasLabelCol, HasPredictionCol):
    """A second regressor on out-of-fold predictions of the first ones.

    The fold of every row must stand in ``foldCol``. Each base is fitted once per fold on the
    other folds and predicts the fold it has not seen; at prediction time a base answers with
    the mean of its fold models. ``meta`` builds the second regressor from its feature names.
    """

    foldCol = Param(Params._dummy(), "foldCol", "fold column", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, foldCol="fold", folds=5):
        super().__init__()
        self._setDefault(foldCol="fold", folds=5)
        self._set(**self._input_kwargs)
        self.bases: list[Estimator] = []
        self.meta: Callable[[list[str]], Estimator] | None = None
        self.threads = 4

    def of(self, bases: Sequence[Estimator], meta: Callable[[list[str]], Estimator], threads=4):
        self.bases, self.meta, self.threads = list(bases), meta, threads
        return self

    @property
    def base_columns(self) -> list[str]:
        return [f"base_{i}" for i in range(len(self.bases))]

    def fit_folds(self, rows: DataFrame) -> list[list[Model]]:
        """Fold models of every base: ``models[base][fold]``."""
        fold, k = F.col(self.getOrDefault(self.foldCol)), self.getOrDefault(self.folds)
        tasks = [
            lambda b=b, i=i: b.fit(rows.filter(fold != i)) for b in self.bases for i in range(k)
        ]
        fitted = side_by_side(rows.sparkSession, tasks, self.threads)
        return [fitted[j * k : (j + 1) * k] for j in range(len(self.bases))]

    def out_of_fold(self, rows: DataFrame, models: list[list[Model]]) -> DataFrame:
        """Every row once, with each base's prediction by the model that has not seen it."""
        fold, parts = F.col(self.getOrDefault(self.foldCol)), []
        for i in range(self.getOrDefault(self.folds)):
            part = rows.filter(fold == i)
            for name, fold_models in zip(self.base_columns, models, strict=True):
                part = predict(fold_models[i], part, name)
            parts.append(part)
        return union_all(parts)

    def _fit(self, df: DataFrame) -> StackingModel:
        with kept(df) as rows:
            models = self.fit_folds(rows)
            with kept(self.out_of_fold(rows, models)) as unseen:
                meta = self.meta(self.base_columns).fit(unseen)
        return self._copyValues(StackingModel(models, meta, self.base_columns))


class StackingModel(Model, HasPredictionCol):
    def __init__(self, models=(), meta=None, names=()):
        super().__init__()
        self.models, self.meta, self.names = list(models), meta, list(names)

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = df
        for name, fold_models in zip(self.names, self.models, strict=True):
            parts = []
            for i, model in enumerate(fold_models):
                parts.append(f"_{name}_{i}")
                scored = predict(model, scored, parts[-1])
            scored = scored.withColumn(name, mean_of(parts)).drop(*parts)
        final = predict(self.meta, scored, "_meta")
        return final.select(*df.columns, F.col("_meta").alias(self.getPredictionCol()))
