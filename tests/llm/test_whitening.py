import numpy as np
import pytest
from pyspark.sql import types as T

from panelforge.llm.whitening import leading_components, offsets, polar_factor, split_subspace, whiten

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def brute(rows, components=4):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    away = fit - sums / n
    cov = away.T @ away / n
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for i, x in good:
        for k in range(min(components, len(sums))):
            e, v = values[-1 - k], vectors[:, -1 - k]
            y = (x - sums / n) @ v / np.sqrt(e)
            out[i, k + 1] = (n, int(((n * x - sums) ** 2).sum()), abs(y), e / np.trace(cov))
    return out


def compare(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    for r in got:
        n, deviation, y, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(abs(r.whitened) - y) < 1e-8 * max(1, y) and abs(r.explained - share) < 1e-10
        assert r.identity_error < 1e-9


def test_whole_table_matches_a_plain_eigensolver(table):
    rows = [(r.vec_id, r.embedding) for r in table("embeddings").collect()]
    got = whiten(table("embeddings")).collect()
    compare(got, brute(rows))
    x = np.floor(256 * np.array([v for _, v in sorted(rows)]))
    for component in range(1, 5):  # one sign for all rows of a component: they are a linear map of the entries
        y = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == component])
        fitted = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=None)[0]
        assert np.allclose(np.column_stack([x, np.ones(len(x))]) @ fitted, y, atol=1e-8)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_components_of_random_matrices(n):
    chance = np.random.default_rng(n)
    a = chance.standard_normal((n, n))
    a = a @ a.T
    values, vectors = leading_components(a, n)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * np.linalg.norm(a))
    assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * np.linalg.norm(a))
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-10)


def test_equal_and_clustered_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((8, 8)))
    for values in ([1.0] * 8, [5, 5, 5, 1, 1, 1, 1, 1], [3, 3, 3, 3, 3 - 1e-9, 0, 0, 0], [1, 1, 2, 0, 0, 1, 1, 2]):
        a = (q * np.array(values, float)) @ q.T
        found, vectors = leading_components(a, 4)
        assert np.allclose(found, sorted(values)[::-1][:4], atol=1e-9)
        assert np.allclose(a @ vectors, vectors * found, atol=1e-8)


def test_polar_factor_and_split():
    a = np.diag([3.0, -2.0, 1e-9, -1e-9])
    assert np.allclose(polar_factor(a), np.diag([1, -1, 1, -1]), atol=1e-6)
    upper, lower = split_subspace(np.diag([9.0, 1.0, 2.0]))
    assert np.allclose(np.abs(upper[:, 0]), [1, 0, 0]) and lower.shape == (3, 2)


def test_deviations_are_exact_beyond_64_bits():
    x = np.array([[2**40, -5], [3, 4]])
    away, squares = offsets(x, 10**6, [7, 9])
    assert squares[0] is None and squares[1] == (3 * 10**6 - 7) ** 2 + (4 * 10**6 - 9) ** 2
    assert np.allclose(away, x - np.array([7, 9]) / 10**6)


def test_odd_rows_repeats_and_clashing_names(spark):
    chance = np.random.default_rng(3)
    rows = [(i, chance.standard_normal(5).tolist()) for i in range(40)]
    rows += [(40 + i, rows[7][1]) for i in range(30)] + [(None, rows[0][1])]
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [1.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    compare(whiten(df.selectExpr("*", "1 AS x", "'q' AS EMBEDDING", "2 AS n")).collect(), brute(rows))


def test_tables_without_variance_give_no_rows(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in flat] == [(1, 1, 2, 512**2), (2, 1, 2, 512**2)]
