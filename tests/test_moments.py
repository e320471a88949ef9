import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators.moments import pair_moments
from panelforge.operators.profile import correlation_matrix, kernel_density


def gapped(rows=400, width=7, seed=3):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(rows, width)) * 10.0 ** np.arange(width) + 1e6
    values[:, 3] += 4.0 * values[:, 2]
    values[rng.random((rows, width)) < 0.3] = np.nan
    return pd.DataFrame(values, columns=[f"c{i}" for i in range(width)])


def frame(spark, table, partitions=5):
    rows = [[None if math.isnan(v) else float(v) for v in r] for r in table.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in table.columns)).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 5])
def test_moments_of_pairs_use_the_rows_with_both(spark, partitions):
    table = gapped()
    for r in pair_moments(frame(spark, table, partitions), list(table.columns)).collect():
        both = table.iloc[:, [r["i"], r["j"]]].to_numpy()
        both = both[np.isfinite(both).all(axis=1)]
        means = both.mean(axis=0)
        ss = (both - means).T @ (both - means)
        assert r["n"] == len(both)
        assert [r["mean_i"], r["mean_j"]] == pytest.approx(means.tolist(), rel=1e-12)
        assert [r["ss_i"], r["ss_j"]] == pytest.approx([ss[0, 0], ss[1, 1]], rel=1e-9)
        assert r["ss_ij"] == pytest.approx(ss[0, 1], abs=1e-9 * math.sqrt(ss[0, 0] * ss[1, 1]))


def test_correlation_of_gapped_columns(spark):
    table = gapped()
    expected = table.corr()
    found = correlation_matrix(frame(spark, table)).collect()
    assert len(found) == 49
    for r in found:
        assert r["r"] == pytest.approx(expected.loc[r["col_a"], r["col_b"]], abs=1e-9)


def test_pairs_without_rows_constants_and_values_that_are_not_finite(spark):
    rows = [(1.0, None, 0.1, 1.0), (2.0, None, 0.1, float("inf")), (None, 3.0, 0.1, 2.0), (4.0, None, 0.1, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, k double, w double").repartition(3)
    found = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df).collect()}
    assert len(found) == 16
    assert [found.pop((c, c)) for c in "aw"] == pytest.approx([1.0, 1.0])
    assert set(found.values()) == {None}
    assert [r["r"] for r in correlation_matrix(df.where("false")).collect()] == [None] * 16


def test_moments_by_group(spark):
    table = gapped(200, 4).fillna(1e6)
    df = frame(spark, table).withColumn("g", F.when(F.col("c0") > 1e6, 1).when(F.col("c0") < 1e6, 0))
    found = {(r["g"], r["i"], r["j"]): r for r in pair_moments(df, ["c0", "c1", "c2"], "g").collect()}
    for g, part in ((0, table[table.c0 < 1e6]), (1, table[table.c0 > 1e6])):
        assert found[g, 0, 1]["n"] == len(part)
        assert found[g, 1, 2]["ss_ij"] == pytest.approx(part["c1"].cov(part["c2"]) * (len(part) - 1), rel=1e-9)
    assert {k[0] for k in found} == {0, 1}


def test_kernel_density_of_a_sample(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500), rng.normal(6.0, 0.5, 300)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double")
    found = kernel_density(df, "v", points=400).orderBy("point").toPandas()
    wide = values.std(ddof=1) * len(values) ** -0.2
    direct = np.exp(-0.5 * ((found.x.to_numpy()[:, None] - values) / wide) ** 2).sum(axis=1) / (len(values) * wide * math.sqrt(2 * math.pi))
    assert len(found) == 400
    assert np.abs(found.density - direct).max() < 2e-4
    assert np.trapezoid(found.density, found.x) == pytest.approx(1.0, abs=3e-3)


@pytest.mark.parametrize("rows", [[], [(2.0,)], [(2.0,), (2.0,), (None,)]])
def test_kernel_density_needs_two_values(spark, rows):
    assert kernel_density(spark.createDataFrame(rows, "v double"), "v").count() == 0
