import numpy as np
import pytest

from panelforge.models import HuberBoosting


def by_hand(x, y, trees, rate, quantile):
    """Two leaves, ``x = 0`` and ``x = 1``."""
    score = np.full(len(y), np.median(y))
    for _ in range(trees):
        residual = y - score
        turn = np.quantile(np.abs(residual), quantile)
        for side in (x == 0, x == 1):
            middle = np.median(residual[side])
            score[side] += rate * (middle + np.clip(residual[side] - middle, -turn, turn).mean())
    return score


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    x = (rng.random(120) < 0.4).astype(float)
    y = 3.0 * x + rng.normal(size=120)
    y[::15] += 500.0
    return x, y


@pytest.mark.parametrize("trees", [1, 3])
def test_rounds_are_those_by_hand(spark, table, trees):
    x, y = table
    df = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, i int")
    model = HuberBoosting(inputCols=["x"], labelCol="y", trees=trees, depth=1, rate=0.3, leafRows=1, pinInterval=2).fit(df)
    out = model.transform(df).orderBy("i").toPandas()
    assert list(out.columns) == ["x", "y", "i", "prediction"]
    assert out.prediction.to_numpy() == pytest.approx(by_hand(x, y, trees, 0.3, 0.9), abs=1e-9)
