"""AdaBoost.R2 (Drucker, 1997) over Spark regression trees."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import pin


class AdaBoostR2(Estimator, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    """Trees fitted one after another on reweighted rows, combined by a weighted median.

    Row weights multiply up from round to round; every ``pinInterval`` rounds they are written
    to scratch storage so that the plan does not grow with the number of trees.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "tree depth", TypeConverters.toInt)
    pinInterval = Param(Params._dummy(), "pinInterval", "rounds per write", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        inputCols=None,
        labelCol="label",
        predictionCol="prediction",
        trees=50,
        rate=1.0,
        depth=3,
        pinInterval=5,
        seed=0,
    ):
        super().__init__()
        self._setDefault(trees=50, rate=1.0, depth=3, pinInterval=5, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> AdaBoostR2Model:
        label, rate = self.getLabelCol(), self.getOrDefault(self.rate)
        assembler = VectorAssembler(inputCols=self.getInputCols(), outputCol="_features")
        rows = assembler.transform(df).select(
            "_features", F.col(label).cast("double").alias("_label"), F.lit(1.0).alias("_weight")
        )
        rows = pin(rows, "adaboost")
        trees, weights = [], []
        for round_number in range(self.getOrDefault(self.trees)):
            tree = DecisionTreeRegressor(
                featuresCol="_features",
                labelCol="_label",
                weightCol="_weight",
                maxDepth=self.getOrDefault(self.depth),
                seed=self.getSeed() + round_number,
            ).fit(rows)
            error = F.abs(F.col("prediction") - F.col("_label"))
            scored = tree.transform(rows).withColumn("_error", error)
            s = scored.agg(
                F.max("_error").alias("worst"),
                F.sum("_weight").alias("weight"),
                F.sum(F.col("_weight") * F.col("_error")).alias("loss"),
            ).first()
            if not s["worst"]:  # a perfect tree decides alone
                trees, weights = [tree], [1.0]
                break
            mean_loss = s["loss"] / s["worst"] / s["weight"]
            if mean_loss >= 0.5:
                if not trees:
                    trees, weights = [tree], [1.0]
                break
            beta = mean_loss / (1.0 - mean_loss)
            trees.append(tree)
            weights.append(rate * math.log(1.0 / beta))
            gain = F.pow(F.lit(beta), (F.lit(1.0) - F.col("_error") / F.lit(s["worst"])) * rate)
            updated = scored.withColumn("_weight", F.col("_weight") * gain)
            rows = updated.select("_features", "_label", "_weight")
            if (round_number + 1) % self.getOrDefault(self.pinInterval) == 0:
                rows = pin(rows, "adaboost")
        model = AdaBoostR2Model(trees, weights)
        return self._copyValues(model)


class AdaBoostR2Model(Model, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    def __init__(self, trees=(), weights=()):
        super().__init__()
        self.members, self.weights = list(trees), list(weights)

    def _transform(self, df: DataFrame) -> DataFrame:
        assembler = VectorAssembler(inputCols=self.getInputCols(), outputCol="_features")
        scored, votes = assembler.transform(df), []
        for i, tree in enumerate(self.members):
            name = f"_tree_{i}"
            scored = tree.copy({tree.predictionCol: name}).transform(scored)
            votes.append(
                F.struct(F.col(name).alias("value"), F.lit(self.weights[i]).alias("weight"))
            )
        chosen = weighted_median(F.array(*votes), sum(self.weights))
        return scored.select(*df.columns, chosen.alias(self.getPredictionCol()))


def weighted_median(votes: Column, total: float) -> Column:
    """First value, in rising order, at which half of the weight is reached."""
    start = F.struct(F.lit(0.0).alias("weight"), F.lit(None).cast("double").alias("value"))

    def step(seen: Column, vote: Column) -> Column:
        weight = seen["weight"] + vote["weight"]
        reached = F.when(weight >= F.lit(0.5 * total), vote["value"])
        return F.struct(weight.alias("weight"), F.coalesce(seen["value"], reached).alias("value"))

    return F.aggregate(F.array_sort(votes), start, step)["value"]
