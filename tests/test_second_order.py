import numpy as np
import pytest

from panelforge.models.second_order import Penalties, SecondOrderBooster, Tree, leaf_wise_boosting, second_order_boosting


def table(spark, n=600, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 7, n), rng.integers(0, 12, n), rng.integers(0, 3, n)], axis=1).astype(float)
    y = 3 * (x[:, 0] > 3) + 2 * (x[:, 1] > 8) * (x[:, 0] <= 3) + rng.normal(0, 0.3, n) + (x[:, 2] == 1)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y double").repartition(parts)


def fitted(model, df):
    return np.array([r.prediction for r in model.fit(df).transform(df).orderBy("id").collect()])


def plain_tree(x, g, costs, depth, min_gain):
    """Level-wise growth by recursion: ``rows -> weights``."""
    out = np.zeros(len(g))

    def grow(rows, left):
        total, best = (g[rows].sum(), len(rows)), None
        if left:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(a), len(b)) < max(costs.min_curvature, costs.leaf_rows):
                        continue
                    gain = sum(costs.score(g[p].sum(), len(p)) for p in (a, b)) - costs.score(*total)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, a, b
        if best:
            kept = [grow(best[1], left - 1), grow(best[2], left - 1)]
            if best[0] >= min_gain or True in kept:
                return True
        out[rows] = costs.weight(*total)
        return False

    grow(np.arange(len(g)), depth)
    return out


@pytest.mark.parametrize(("l1", "l2", "min_gain", "curvature"), [(0, 0, 0, 0), (5, 20, 0, 10), (2, 1, 12, 1)])
def test_level_wise_boosting_matches_a_plain_loop(spark, l1, l2, min_gain, curvature):
    x, y, df = table(spark)
    booster = second_order_boosting(["a", "b", "c"], "y", trees=3, rate=0.4, depth=2, l1=l1, l2=l2, min_gain=min_gain, min_curvature=curvature)
    p = np.full(len(y), 0.5)
    for _ in range(3):
        p = p + 0.4 * plain_tree(x, p - y, Penalties(l2, l1, curvature, 1), 2, min_gain)
    assert np.allclose(fitted(booster, df), p, atol=1e-9)


def test_written_predictions_and_partitions_do_not_change_the_fit(spark):
    x, y, df = table(spark)
    got = [
        fitted(SecondOrderBooster(inputCols=["a", "b"], labelCol="y", trees=7, depth=3, pinInterval=k, l2=3.0), part)
        for k, part in ((1, df), (3, df.repartition(1)), (100, df.repartition(5)))
    ]
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])
    assert np.mean((got[0] - y) ** 2) < 0.6 * np.var(y)


def test_leaf_wise_growth_splits_where_most_is_gained(spark):
    # all structure lies on the right: a leaf-wise tree spends its leaves there, a level-wise one cannot
    high = {12: 100.0, 13: 130.0, 14: 170.0, 15: 240.0}
    rows = [(i, float(i % 16), high.get(i % 16, 0.0)) for i in range(480)]
    df = spark.createDataFrame(rows, "id int, a double, y double")
    leaf = leaf_wise_boosting(["a"], "y", trees=1, rate=1.0, leaves=5, row_share=1.0, leaf_rows=1, min_curvature=1.0)
    level = SecondOrderBooster(inputCols=["a"], labelCol="y", trees=1, rate=1.0, depth=2, l2=0.0)
    y = np.array([r[2] for r in rows])
    assert np.allclose(fitted(leaf, df), y) and len(set(fitted(level, df).round(6))) == 3
    tree = leaf.fit(df).members[0]
    assert sorted(t for f, t in zip(tree.feature, tree.threshold) if f >= 0) == [11.0, 12.0, 13.0, 14.0]


def test_missing_values_samples_and_constant_columns(spark):
    rows = [(i, None if i % 5 == 0 else float(i % 4), 1.0, float(i % 5 == 0) if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double")
    model = SecondOrderBooster(inputCols=["a", "b"], labelCol="y", trees=30, rate=0.5, depth=2).fit(df)
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert all(abs(p - (i % 5 == 0)) < 0.01 for i, p in got.items()) and len(got) == 500
    assert model.total_gains()["a"] > 0 == model.total_gains()["b"]
    x, y, df = table(spark)
    one, two, other = (
        fitted(leaf_wise_boosting(["a", "b", "c"], "y", trees=6, feature_share=0.7, min_curvature=1.0, seed=s), part)
        for s, part in ((3, df), (3, df), (4, df))
    )
    assert np.array_equal(one, two) and not np.array_equal(one, other)
    with pytest.raises(ValueError):
        SecondOrderBooster(inputCols=["a"], labelCol="y").fit(df.where("id < 0"))


def test_trees_place_rows_by_edges_and_thresholds():
    tree = Tree.root()
    left, right = tree.split(0, 0, 1, 2.5, 1.0)
    tree.split(right, 1, 0, float("-inf"), 1.0)
    x = np.array([[2.5, 9], [3.0, np.nan], [3.0, 0.0], [np.nan, 1.0]])
    bins = np.array([[1, 5], [2, 0], [2, 1], [0, 1]])
    assert tree.place(x, tree.threshold).tolist() == tree.place(bins, tree.edge).tolist() == [1, 3, 4, 1]
