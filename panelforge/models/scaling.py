"""Robust scaling as a pipeline stage, with exact interpolated quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.quantiles import exact_quantiles


class _Scaled(HasInputCols, HasOutputCol):
    def _assemble(self, df: DataFrame, centres: Sequence[float], spreads: Sequence[float]):
        names = self.getInputCols()
        scaled = {
            f"_scaled_{i}": (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
            for i, (c, m, s) in enumerate(zip(names, centres, spreads, strict=True))
        }
        assembler = VectorAssembler(inputCols=list(scaled), outputCol=self.getOutputCol())
        return assembler.transform(df.withColumns(scaled)).drop(*scaled)


class QuartileScaler(Estimator, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    """Assemble columns into a vector of ``(x − median) / interquartile range``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> QuartileScalerModel:
        names = self.getInputCols()
        row = exact_quantiles(df, [], names, [0.25, 0.5, 0.75]).first()
        centres = [float(row[c][1] or 0.0) for c in names]
        spreads = [float(((row[c][2] or 0.0) - (row[c][0] or 0.0)) or 1.0) for c in names]
        model = QuartileScalerModel(centres=centres, spreads=spreads)
        return self._copyValues(model)


class QuartileScalerModel(Model, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    centres = Param(Params._dummy(), "centres", "medians", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "quartile ranges", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features", centres=None, spreads=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._assemble(
            df, self.getOrDefault(self.centres), self.getOrDefault(self.spreads)
        )
