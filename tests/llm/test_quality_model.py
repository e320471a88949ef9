import zlib

import numpy as np
import pytest

from panelforge.llm import quality_model as q


def test_scores_match_the_densities(spark):
    rng = np.random.default_rng(4)
    k = len(q.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (300, k)), rng.normal(0.5, 2, (100, k))])
    y = [1] * 300 + [0] * 100
    names = ", ".join(f"{f} double" for f in q.FEATURES)
    rows = spark.createDataFrame([(*map(float, r), c) for r, c in zip(x, y, strict=True)], names + ", label int")
    model = q.fit(rows, shrink=0.2, floor=1e-3)
    own = [np.cov(x[np.array(y) == c].T, bias=True) for c in (0, 1)]
    pooled = 0.25 * own[0] + 0.75 * own[1]
    logs = []
    for c in (0, 1):
        cov = 0.8 * own[c] + 0.2 * np.diag(np.diag(pooled) + 1e-3) + 1e-3 * np.eye(k)
        off = x - x[np.array(y) == c].mean(axis=0)
        square = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        logs.append(np.log([0.25, 0.75][c]) - 0.5 * (np.linalg.slogdet(cov)[1] + square))
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)
    assert q.fit(rows.where("label = 1")) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = q.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, junk = ([r.score for r in rows if r.quality == c] for c in (1, 0))
    ahead = np.mean([(g > j) + 0.5 * (g == j) for g in good for j in junk])
    assert ahead > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.97


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "a"), (5, "word " * 100_000), (6, "É\x00|!")]
    docs = docs_of(rows).selectExpr("*", "1 AS TEXT", "2 AS score", "3 AS length")
    labels = spark.createDataFrame(
        [(1, 1), (2, 0), (3, 1), (5, 0), (6, 1), (6, None), (None, 1), (99, 0), (1, 7)], "doc_id long, quality int"
    )
    got = q.quality_scores(docs, labels.selectExpr("*", "'x' AS lang")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert {r.score for r in q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert q.quality_scores(docs_of([]), labels).collect() == []
