"""Tree ensembles on Spark's distributed tree learners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor


def _with_features(features: Sequence[str], learner) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    return Pipeline(stages=[assembler, learner])


def _share(part: float) -> str:
    """A share of the features, as Spark names it."""
    return "all" if part >= 1.0 else str(part)


def random_forest(
    features: Sequence[str],
    label: str,
    trees: int = 10,
    depth: int = 10,
    seed: int = 0,
    bootstrap: bool = True,
) -> Pipeline:
    learner = RandomForestRegressor(
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        featureSubsetStrategy="all",
        seed=seed,
        bootstrap=bootstrap,
    )
    return _with_features(features, learner)


def gradient_boosting(
    features: Sequence[str],
    label: str,
    trees: int = 460,
    rate: float = 0.193069,
    depth: int = 4,
    leaf_rows: int = 15,
    loss: str = "squared",
    seed: int = 5,
) -> Pipeline:
    """Boosting over random halves of the features; ``loss`` is ``squared`` or ``absolute``.

    Huber's loss, which Spark lacks, is that of ``HuberBoosting``.
    """
    learner = GBTRegressor(
        labelCol=label,
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        minInstancesPerNode=leaf_rows,
        featureSubsetStrategy="sqrt",
        lossType=loss,
        seed=seed,
    )
    return _with_features(features, learner)


def regularised_boosting(
    features: Sequence[str],
    label: str,
    trees: int = 2200,
    rate: float = 0.0373,
    depth: int = 3,
    row_share: float = 0.71268,
    min_gain: float = 0.0,
    leaf_rows: int = 1,
    seed: int = 7,
    feature_share: float = 1.0,
) -> Pipeline:
    """Boosting on row and feature samples with a least gain per split.

    Spark has no weight penalty on leaves; row sampling and ``min_gain`` are what it offers.
    """
    learner = GBTRegressor(
        labelCol=label,
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        subsamplingRate=row_share,
        minInfoGain=min_gain,
        featureSubsetStrategy=_share(feature_share),
        minInstancesPerNode=leaf_rows,
        seed=seed,
    )
    return _with_features(features, learner)


def histogram_boosting(
    features: Sequence[str],
    label: str,
    trees: int = 800,
    rate: float = 0.33598,
    bins: int = 55,
    depth: int = 3,
    row_share: float = 0.8,
    leaf_rows: int = 6,
    seed: int = 9,
    feature_share: float = 1.0,
) -> Pipeline:
    """Boosting on coarse histograms. Depth 3 is the least that holds five leaves."""
    learner = GBTRegressor(
        labelCol=label,
        maxIter=trees,
        stepSize=rate,
        maxDepth=depth,
        maxBins=bins,
        featureSubsetStrategy=_share(feature_share),
        subsamplingRate=row_share,
        minInstancesPerNode=leaf_rows,
        seed=seed,
    )
    return _with_features(features, learner)
