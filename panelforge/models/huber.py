"""Gradient boosting of regression trees under Huber's loss (Friedman, 2001)."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.quantiles import exact_quantiles
from panelforge.session import pin, unpin


def _clipped(value: Column, turn: float) -> Column:
    return F.greatest(F.least(value, F.lit(turn)), F.lit(-turn))


def _of_leaf(values: list[float]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("_leaf"))


class HuberBoosting(Estimator, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    """Boosting that counts large residuals by their size only, not by their square.

    In each round the ``quantile`` of the absolute residuals is the turn from square to absolute loss, a tree learns
    the residuals clipped there, and each of its leaves adds the median of its residuals plus the mean of what is
    left, clipped. All quantiles are exact. Rows with their scores are written every ``pinInterval`` rounds; only
    one number per leaf and round reaches the driver.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    leafRows = Param(Params._dummy(), "leafRows", "least rows of a leaf", TypeConverters.toInt)
    quantile = Param(Params._dummy(), "quantile", "share of residuals under square loss", TypeConverters.toFloat)
    features = Param(Params._dummy(), "features", "features per split, as in forests", TypeConverters.toString)
    pinInterval = Param(Params._dummy(), "pinInterval", "rounds per write", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols=None,
        labelCol="label",
        predictionCol="prediction",
        trees=3000,
        rate=0.05,
        depth=4,
        leafRows=15,
        quantile=0.9,
        features="sqrt",
        pinInterval=5,
        seed=5,
    ):
        super().__init__()
        self._setDefault(trees=3000, rate=0.05, depth=4, leafRows=15, quantile=0.9, features="sqrt", pinInterval=5, seed=5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> HuberBoostingModel:
        rate, quantile = self.getOrDefault(self.rate), self.getOrDefault(self.quantile)
        label = F.col(self.getLabelCol()).cast("double").alias("_label")
        assembled = VectorAssembler(inputCols=self.getInputCols(), outputCol="_features").transform(df)
        rows = held = pin(assembled.select("_features", label), "huber")
        start = exact_quantiles(rows, [], ["_label"], [0.5]).first()["_label"][0]
        rows, members = rows.withColumn("_score", F.lit(start)), []
        for number in range(self.getOrDefault(self.trees)):
            residuals = rows.withColumn("_residual", F.col("_label") - F.col("_score"))
            sizes = residuals.select(F.abs("_residual").alias("size"))
            turn = exact_quantiles(sizes, [], ["size"], [quantile]).first()["size"][0]
            targets = residuals.withColumn("_target", _clipped(F.col("_residual"), turn))
            forest = RandomForestRegressor(
                featuresCol="_features",
                labelCol="_target",
                numTrees=1,
                bootstrap=False,
                maxDepth=self.getOrDefault(self.depth),
                minInstancesPerNode=self.getOrDefault(self.leafRows),
                featureSubsetStrategy=self.getOrDefault(self.features),
                leafCol="_leaves",
                seed=self.getSeed() + number,
            ).fit(targets)
            leaf = vector_to_array("_leaves")[0].cast("int")
            placed = forest.transform(targets).withColumn("_leaf", leaf)
            leaves = (forest.trees[0].numNodes + 1) // 2
            medians = [0.0] * leaves
            for r in exact_quantiles(placed, ["_leaf"], ["_residual"], [0.5]).collect():
                medians[r["_leaf"]] = r["_residual"][0]
            rest = _clipped(F.col("_residual") - _of_leaf(medians), turn)
            values = list(medians)
            for r in placed.groupBy("_leaf").agg(F.avg(rest).alias("rest")).collect():
                values[r["_leaf"]] += r["rest"]
            members.append((forest, values))
            score = F.col("_score") + _of_leaf(values) * rate
            rows = placed.select("_features", "_label", score.alias("_score"))
            if (number + 1) % self.getOrDefault(self.pinInterval) == 0:
                rows, last = pin(rows, "huber"), held
                held = rows
                unpin(last)
        unpin(held)
        return self._copyValues(HuberBoostingModel(start, rate, members))


class HuberBoostingModel(Model, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    def __init__(self, start: float = 0.0, step: float = 1.0, members=()):
        super().__init__()
        self.start, self.step, self.members = start, step, list(members)

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = VectorAssembler(inputCols=self.getInputCols(), outputCol="_features").transform(df)
        scored = scored.withColumn("_score", F.lit(self.start))
        for forest, values in self.members:
            names = {forest.leafCol: "_leaves", forest.predictionCol: "_part"}
            placed = forest.copy(names).transform(scored).withColumn("_leaf", vector_to_array("_leaves")[0].cast("int"))
            score = F.col("_score") + _of_leaf(values) * self.step
            scored = placed.withColumn("_score", score).drop("_leaves", "_leaf", "_part")
        return scored.select(*df.columns, F.col("_score").alias(self.getPredictionCol()))
