"""Boosting with gradients and curvatures on binned features.

Bin edges come from one sketch pass. The rows are written once with their bins; of each level, or each split, the
tasks send sums of gradients, curvatures and rows per (node, feature, bin), and one aggregation adds them up. The driver
sees only these histograms, whose size the tree and the bins bound, never rows. Only the smaller child of a split is
counted, its sibling is the parent less that. Predictions so far are written again every ``pinInterval`` trees.

``growth="depth"`` splits all nodes of a level and afterwards takes back splits that gain less than ``minGain``, from the
leaves up; ``growth="leaf"`` splits the leaf that gains most until there are ``leaves``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import pin, unpin

HISTOGRAM_SCHEMA = "node int, feature int, bin int, gradient double, curvature double, n long"
#: Rank error of the sketch that places the bin edges.
SKETCH_ERROR = 1e-3


@dataclass
class Tree:
    """Nodes in order of creation; ``feature`` is -1 at leaves, rows with a value up to ``threshold`` or none go left."""

    feature: list[int]
    edge: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    @classmethod
    def root(cls) -> Tree:
        return cls([-1], [0], [0.0], [-1], [-1], [0.0], [0.0])

    def split(self, node: int, feature: int, edge: int, threshold: float, gain: float) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.edge[node], self.threshold[node], self.gain[node] = feature, edge, threshold, gain
        self.left[node], self.right[node] = children
        for column, empty in zip(vars(self).values(), (-1, 0, 0.0, -1, -1, 0.0, 0.0), strict=True):
            column += [empty, empty]
        return children

    def is_leaf(self, node: int) -> bool:
        return self.feature[node] < 0

    def place(self, columns: np.ndarray, limits: Sequence) -> np.ndarray:
        """The leaf of each row of ``columns``; ``limits`` are thresholds, or edges for binned columns."""
        feature, limit = np.array(self.feature), np.array(limits)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(columns), np.int64)
        rows = np.arange(len(columns))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return node
            above = columns[rows, np.maximum(f, 0)] > limit[node]  # a missing value compares false: left
            node = np.where(inner, np.where(above, right[node], left[node]), node)


@dataclass(frozen=True)
class Penalties:
    """What a leaf and a split cost; see ``SecondOrderBooster``."""

    l2: float
    l1: float
    min_curvature: float
    leaf_rows: int

    def shrunk(self, gradient):
        return np.sign(gradient) * np.maximum(np.abs(gradient) - self.l1, 0.0)

    def score(self, gradient, curvature):
        return self.shrunk(gradient) ** 2 / np.maximum(curvature + self.l2, 1e-300)

    def weight(self, gradient: float, curvature: float) -> float:
        return float(-self.shrunk(gradient) / (curvature + self.l2)) if curvature + self.l2 > 0 else 0.0

    def best_split(self, histogram: np.ndarray, features: Sequence[int]) -> tuple[float, int, int] | None:
        """``(gain, feature, last bin on the left)``; of equal gains the first feature and bin."""
        left = histogram.cumsum(axis=1)
        total = left[0, -1]
        right = total - left
        allowed = (
            (left[..., 2] >= self.leaf_rows)
            & (right[..., 2] >= self.leaf_rows)
            & (left[..., 1] >= self.min_curvature)
            & (right[..., 1] >= self.min_curvature)
        )
        allowed[[f for f in range(len(histogram)) if f not in set(features)]] = False
        gain = self.score(left[..., 0], left[..., 1]) + self.score(right[..., 0], right[..., 1]) - self.score(total[0], total[1])
        gain = np.where(allowed & (left[..., 2] > 0) & (right[..., 2] > 0), gain, -np.inf)
        feature, edge = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (float(gain[feature, edge]), int(feature), int(edge)) if gain[feature, edge] > 1e-12 else None


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Rising upper edges of each column's bins but the last, from a sketch; missing values are not counted."""
    steps = [k / bins for k in range(1, bins)]
    found = df.approxQuantile(list(columns), [0.0, *steps, 1.0], min(SKETCH_ERROR, 0.1 / bins))
    return [np.unique(np.array(f, float))[:-1] for f in found]


def sampled(rows: np.ndarray, seed: int, draw: int, share: float) -> np.ndarray:
    """A seeded sample by row number: the same wherever and whenever a row is read."""
    x = rows.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2.0**64), (1 << 64) - 1))


class SecondOrderBooster(Estimator, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    """Trees fitted to the gradients of the squared error, half the square of ``prediction - label``.

    A leaf with gradients ``G`` and curvatures ``H`` has the weight ``-T(G) / (H + l2)``, where ``T`` moves ``G`` by ``l1``
    towards 0; a split gains the sum of ``T(G)**2 / (H + l2)`` of its children less that of the parent and needs
    ``minCurvature`` and ``leafRows`` on both sides. ``base`` is the first prediction, ``nan`` the mean of the labels.
    Each tree sees ``featureShare`` of the features and ``rowShare`` of the rows, drawn anew every ``baggingInterval``
    trees. Rows without a label are not used; missing features go left. A table without rows is an error.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    growth = Param(Params._dummy(), "growth", "depth or leaf", TypeConverters.toString)
    depth = Param(Params._dummy(), "depth", "greatest depth, 0: any", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "greatest number of leaves, 0: any", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on squared leaf weights", TypeConverters.toFloat)
    l1 = Param(Params._dummy(), "l1", "penalty on absolute leaf weights", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "least gain of a split", TypeConverters.toFloat)
    minCurvature = Param(Params._dummy(), "minCurvature", "least curvature of a child", TypeConverters.toFloat)
    leafRows = Param(Params._dummy(), "leafRows", "least rows of a child", TypeConverters.toInt)
    rowShare = Param(Params._dummy(), "rowShare", "share of rows per sample", TypeConverters.toFloat)
    baggingInterval = Param(Params._dummy(), "baggingInterval", "trees per sample", TypeConverters.toInt)
    featureShare = Param(Params._dummy(), "featureShare", "share of features per tree", TypeConverters.toFloat)
    base = Param(Params._dummy(), "base", "first prediction", TypeConverters.toFloat)
    pinInterval = Param(Params._dummy(), "pinInterval", "trees per write", TypeConverters.toInt)
    DEFAULTS = dict(
        trees=100, rate=0.1, growth="depth", depth=6, leaves=0, bins=255, l2=1.0, l1=0.0, minGain=0.0, minCurvature=1.0,
        leafRows=1, rowShare=1.0, baggingInterval=1, featureShare=1.0, base=float("nan"), pinInterval=10, seed=0,
    )

    @keyword_only
    def __init__(
        self, *, inputCols=None, labelCol="label", predictionCol="prediction", trees=100, rate=0.1, growth="depth", depth=6,
        leaves=0, bins=255, l2=1.0, l1=0.0, minGain=0.0, minCurvature=1.0, leafRows=1, rowShare=1.0, baggingInterval=1,
        featureShare=1.0, base=float("nan"), pinInterval=10, seed=0,
    ):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> SecondOrderModel:
        names, get = self.getInputCols(), self.getOrDefault
        columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
        label = F.col(self.getLabelCol()).cast("double").alias("y")
        rows = df.select(*columns, label).where("y IS NOT NULL AND NOT isnan(y)")
        edges = bin_edges(rows, [f"x{i}" for i in range(len(names))], get(self.bins))
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        binned = pin(numbered.mapInArrow(_binner(edges), "row long, y double, bins binary"), "boosting-rows")
        mean = binned.agg(F.avg("y")).first()[0]
        if mean is None:
            raise ValueError("no row has a label")
        base = get(self.base) if get(self.base) == get(self.base) else float(mean)
        state = pin(binned.select("*", F.lit(base).alias("p")), "boosting-state")
        unpin(binned)
        chance, done, pending = np.random.default_rng(self.getSeed()), [], []
        for number in range(get(self.trees)):
            count = max(1, round(get(self.featureShare) * len(names)))
            features = sorted(chance.choice(len(names), count, replace=False).tolist())
            tree = self._grow(_Rows(state, pending, self, number, edges), features, edges)
            done.append(tree)
            pending.append(tree)
            if len(pending) == get(self.pinInterval) and number + 1 < get(self.trees):
                last, state = state, pin(_advanced(state, pending, get(self.rate)), "boosting-state")
                unpin(last)
                pending = []
        unpin(state)
        return self._copyValues(SecondOrderModel(done, base, get(self.rate)))

    def _grow(self, rows: _Rows, features: list[int], edges: list[np.ndarray]) -> Tree:
        get = self.getOrDefault
        costs = Penalties(get(self.l2), get(self.l1), get(self.minCurvature), get(self.leafRows))
        tree = Tree.root()
        histograms = rows.histograms(tree, [0])
        depth, by_leaf = {0: 0}, get(self.growth) == "leaf"
        best = {0: costs.best_split(histograms[0], features)}
        open_, leaves = [0], 1
        while open_:
            fit = [n for n in open_ if best[n] and (not get(self.depth) or depth[n] < get(self.depth))]
            if by_leaf:
                fit = sorted((n for n in fit if best[n][0] >= get(self.minGain)), key=lambda n: (-best[n][0], n))[:1]
            if get(self.leaves):
                fit = fit[: get(self.leaves) - leaves]
            if not fit:
                break
            pairs = []
            for n in fit:
                gain, f, edge = best[n]
                rising = histograms[n][f].cumsum(axis=0)
                left, right = tree.split(n, f, edge, _threshold(edges[f], edge), gain)
                smaller = left if rising[edge, 2] * 2 <= rising[-1, 2] else right
                pairs.append((n, smaller, left + right - smaller))
                depth[left] = depth[right] = depth[n] + 1
                leaves += 1
            counted = rows.histograms(tree, [smaller for _, smaller, _ in pairs])
            for n, smaller, other in pairs:
                histograms[smaller], histograms[other] = counted[smaller], histograms[n] - counted[smaller]
                for child in (smaller, other):
                    best[child] = costs.best_split(histograms[child], features)
            open_ = [n for n in open_ if n not in fit] if by_leaf else []
            open_ += [c for _, a, b in pairs for c in sorted((a, b))]
        if not by_leaf:
            for n in reversed(range(len(tree.feature))):
                weak = not tree.is_leaf(n) and tree.gain[n] < get(self.minGain)
                if weak and tree.is_leaf(tree.left[n]) and tree.is_leaf(tree.right[n]):
                    tree.feature[n] = tree.left[n] = tree.right[n] = -1
        for n, histogram in histograms.items():
            gradient, curvature, _ = histogram[0].sum(axis=0)
            tree.value[n] = costs.weight(gradient, curvature) if tree.is_leaf(n) else 0.0
        return tree


def _threshold(edges: np.ndarray, edge: int) -> float:
    """The largest value in bins up to ``edge``; bin 0 holds what is missing."""
    return float(edges[edge - 1]) if edge else float("-inf")


def _binner(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((batch.num_rows, len(edges)), np.uint16)
            for i, e in enumerate(edges):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                bins[:, i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left"))
            raw = bins.tobytes()
            width = 2 * len(edges)
            packed = [raw[k : k + width] for k in range(0, len(raw), width)] if width else [b""] * len(bins)
            yield pa.record_batch([batch.column(len(edges) + 1), batch.column(len(edges)), pa.array(packed, pa.binary())], ["row", "y", "bins"])

    return run


def _unpacked(column: pa.Array, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, features)


def _sum_of(trees: list[Tree], columns: np.ndarray, rate: float, binned: bool) -> np.ndarray:
    out = np.zeros(len(columns))
    for tree in trees:
        out += rate * np.array(tree.value)[tree.place(columns, tree.edge if binned else tree.threshold)]
    return out


def _advanced(state: DataFrame, trees: list[Tree], rate: float) -> DataFrame:
    trees = list(trees)

    def run(batches):
        for batch in batches:
            raw = batch.column(2)
            bins = _unpacked(raw, len(raw[0].as_py()) // 2) if batch.num_rows else np.zeros((0, 1), np.uint16)
            moved = pa.array(batch.column(3).to_numpy() + _sum_of(trees, bins, rate, True))
            yield pa.record_batch([*batch.columns[:3], moved], ["row", "y", "bins", "p"])

    return state.mapInArrow(run, "row long, y double, bins binary, p double")


class _Rows:
    """The rows as one tree sees them."""

    def __init__(self, state, pending, booster, number, edges):
        get = booster.getOrDefault
        self.state, self.pending, self.rate = state, list(pending), get(booster.rate)
        self.seed, self.share = booster.getSeed(), get(booster.rowShare)
        self.draw = number // get(booster.baggingInterval)
        self.shape = (len(edges), max(len(e) for e in edges) + 2)

    def histograms(self, tree: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        """Sums of gradient, curvature and rows of the given leaves, by feature and bin."""
        features, width = self.shape
        pending, rate, seed, share, draw = self.pending, self.rate, self.seed, self.share, self.draw
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))

        def run(batches):
            size = len(nodes) * features * width
            total = np.zeros((3, size))
            for batch in batches:
                if share < 1.0:
                    batch = batch.filter(pa.array(sampled(batch.column(0).to_numpy(), seed, draw, share)))
                if not batch.num_rows:
                    continue
                bins = _unpacked(batch.column(2), features)
                mine = slot[tree.place(bins, tree.edge)]
                there = mine >= 0
                bins, mine = bins[there], mine[there]
                p = batch.column(3).to_numpy()[there] + _sum_of(pending, bins, rate, True)
                gradient = np.repeat(p - batch.column(1).to_numpy()[there], features)
                cell = ((mine[:, None] * features + np.arange(features)) * width + bins).reshape(-1)
                total[0] += np.bincount(cell, gradient, size)
                n = np.bincount(cell, minlength=size)
                total[1] += n  # the curvature of the squared error is 1
                total[2] += n
            found = np.flatnonzero(total[2])
            if len(found):
                columns = [found // (features * width), found // width % features, found % width]
                yield pa.record_batch(
                    [*(pa.array(c, pa.int32()) for c in columns), *(pa.array(total[k][found]) for k in (0, 1)), pa.array(total[2][found].astype(np.int64))],
                    ["node", "feature", "bin", "gradient", "curvature", "n"],
                )

        parts = self.state.mapInArrow(run, HISTOGRAM_SCHEMA).groupBy("node", "feature", "bin")
        sums = parts.agg(*[F.sum(c).alias(c) for c in ("gradient", "curvature", "n")]).toArrow()
        out = np.zeros((len(nodes), features, width, 3))
        at = tuple(sums.column(c).to_numpy() for c in ("node", "feature", "bin"))
        for k, c in enumerate(("gradient", "curvature", "n")):
            out[(*at, k)] = sums.column(c).to_numpy()
        return {n: out[i] for i, n in enumerate(nodes)}


class SecondOrderModel(Model, HasInputCols, HasLabelCol, HasPredictionCol, HasSeed):
    def __init__(self, trees: Sequence[Tree] = (), base: float = 0.0, rate: float = 1.0):
        super().__init__()
        self.members, self.base, self.rate = list(trees), base, rate

    def _transform(self, df: DataFrame) -> DataFrame:
        members, base, rate = self.members, self.base, self.rate

        @F.pandas_udf("double")
        def score(columns: pd.DataFrame) -> pd.Series:
            return pd.Series(base + _sum_of(members, columns.to_numpy(float), rate, False))

        inputs = F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.getInputCols())])
        return df.withColumn(self.getPredictionCol(), score(inputs))

    def total_gains(self) -> dict[str, float]:
        """What the splits on each feature have gained in all trees."""
        out = dict.fromkeys(self.getInputCols(), 0.0)
        for tree in self.members:
            for feature, gain in zip(tree.feature, tree.gain, strict=True):
                if feature >= 0:
                    out[self.getInputCols()[feature]] += gain
        return out


def second_order_boosting(
    features: Sequence[str], label: str, trees: int = 2200, rate: float = 0.0373, depth: int = 3, l1: float = 0.0, l2: float = 1.0,
    min_gain: float = 0.0, min_curvature: float = 1.0, row_share: float = 1.0, feature_share: float = 1.0, base: float = 0.5,
    bins: int = 255, seed: int = 7,
) -> SecondOrderBooster:
    """Level by level, with penalties on leaf weights; every tree has its own sample."""
    return SecondOrderBooster(
        inputCols=list(features), labelCol=label, trees=trees, rate=rate, growth="depth", depth=depth, l1=l1, l2=l2, minGain=min_gain,
        minCurvature=min_curvature, rowShare=row_share, featureShare=feature_share, base=base, bins=bins, seed=seed,
    )


def leaf_wise_boosting(
    features: Sequence[str], label: str, trees: int = 800, rate: float = 0.33598, leaves: int = 5, bins: int = 55, row_share: float = 0.8,
    bagging_interval: int = 5, feature_share: float = 1.0, leaf_rows: int = 6, min_curvature: float = 11.0, l1: float = 0.0,
    l2: float = 0.0, depth: int = 0, seed: int = 9,
) -> SecondOrderBooster:
    """Leaf by leaf on coarse bins; a sample serves ``bagging_interval`` trees."""
    return SecondOrderBooster(
        inputCols=list(features), labelCol=label, trees=trees, rate=rate, growth="leaf", leaves=leaves, depth=depth, bins=bins, l1=l1, l2=l2,
        rowShare=row_share, baggingInterval=bagging_interval, featureShare=feature_share, leafRows=leaf_rows,
        minCurvature=min_curvature, seed=seed,
    )
