import numpy as np
import pytest
from pyspark.sql import types as T

from panelforge.llm.vantage import build_tree, distances, nearest_neighbours, search_tree

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))]
)


def brute(rows, k=10, each=100):
    """The ``(query_id, rank, vec_id, score)`` of exact search."""
    good = [
        (i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)
    ]
    out = []
    for a, (query, q) in enumerate(good):
        if query is None or query % each:
            continue
        found = [(distances(q[None], v[None])[0, 0], i is None, i or 0) for b, (i, v) in enumerate(good) if a != b]
        out += [(query, n + 1, None if x[1] else x[2], x[0]) for n, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_rows", [60, 5000])
def test_factor_one_is_exact_on_the_whole_table(table, shard_rows):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    got = nearest_neighbours(table("embeddings"), shard_rows=shard_rows, block=2)
    assert found(got) == brute(rows)


def test_trees_prune_and_relaxed_ones_prune_more():
    chance = np.random.default_rng(5)
    x = chance.standard_normal((40, 4))[chance.integers(0, 40, 4000)] * 5 + chance.standard_normal((4000, 4))
    q = x[::80]
    tree = build_tree(x, np.arange(4000), np.zeros(4000, bool), np.arange(4000))
    true = np.sort(distances(q, x), axis=1)[:, :10]
    made = []
    for factor in (1.0, 0.7, 0.4):
        best, n = search_tree(tree, q, 10, factor)
        recall = (best.distance <= true[:, -1:] + 1e-12).mean()
        assert recall == 1.0 if factor == 1.0 else recall >= 0.9
        made.append(n)
    assert made[0] < 0.6 * q.shape[0] * len(x) and made == sorted(made, reverse=True)
    assert np.array_equal(search_tree(tree, q, 10)[0].distance, true)


def test_ties_copies_repeated_ids_and_nulls(spark):
    chance = np.random.default_rng(2)
    rows = [(i, chance.integers(-1, 2, 3).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 0.5]) for i in range(400)] + [(100, [2.0, 0.0, 1.0])] * 15
    rows += [(None, [2.0, 0.0, 1.0]), (None, [0.1, 0.2, 0.3])]
    bad = [(2000, None), (2100, []), (2200, [0.0] * 3), (2300, [None, 1.0, 1.0]), (2400, [float("nan"), 1.0, 1.0]), (2500, [float("inf")] * 3)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS place", "'x' AS VEC_ID", "2 AS rank")
    for shard_rows, block in ((50, 3), (10_000, 500)):
        assert found(nearest_neighbours(df, shard_rows=shard_rows, block=block)) == brute(rows)


def test_few_rows_and_empty_tables(spark):
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = spark.createDataFrame([(100, [1.0]), (3, None), (4, [1.0, 2.0])], SCHEMA)
    assert nearest_neighbours(lone).collect() == []
    few = spark.createDataFrame([(100, [1.0]), (3, [4.0]), (200, [3.0])], SCHEMA)
    assert found(nearest_neighbours(few)) == [(100, 1, 200, 2.0), (100, 2, 3, 3.0), (200, 1, 3, 1.0), (200, 2, 100, 2.0)]


def test_relaxed_search_on_the_whole_table(table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    want = {(a, c) for a, _, c, _ in brute(rows)}
    got = {(a, c) for a, _, c, _ in found(nearest_neighbours(table("embeddings"), factor=0.3, shard_rows=100))}
    assert len(want & got) >= 0.9 * len(want)
