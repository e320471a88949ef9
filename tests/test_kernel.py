import numpy as np
import pandas as pd
import pytest

from panelforge.models import KernelRidge
from panelforge.models.ensemble import predict
from panelforge.models.kernel import polynomial_kernel, whitening

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 2, (90, 3))
    return x, 3 * x[:, 0] - x[:, 1] * x[:, 2] + rng.normal(0, 0.1, 90) + 7


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y = sample
    return spark.createDataFrame(pd.DataFrame(x, columns=COLUMNS).assign(y=y, id=range(len(y)))).repartition(3).cache()


def exact(x, y, alpha, gamma, coef0, degree, positive=False):
    kernel = polynomial_kernel(x, x, gamma, coef0, degree)
    if positive:
        values, vectors = np.linalg.eigh(kernel)
        kernel = vectors * np.maximum(values, 0) @ vectors.T
    centre = np.eye(len(y)) - 1 / len(y)
    kc = centre @ kernel @ centre
    return kc @ np.linalg.solve(kc + alpha * np.eye(len(y)), y - y.mean()) + y.mean()


def scores(model, table):
    return [r["p"] for r in predict(model, table, "p").orderBy("id").collect()]


@pytest.mark.parametrize(("degree", "coef0", "alpha"), [(1.1288, 12.9155, 0.4), (2.0, 2.5, 0.6), (3.0, 1.0, 2.0)])
def test_all_rows_as_landmarks_give_the_exact_solution(table, sample, degree, coef0, alpha):
    model = KernelRidge(inputCols=COLUMNS, labelCol="y", alpha=alpha, degree=degree, coef0=coef0, landmarks=90).fit(table)
    assert len(model.marks) == 90
    got = scores(model, table)
    assert got == pytest.approx(list(exact(*sample, alpha, 1 / 3, coef0, degree, positive=True)), abs=1e-6)
    # a broken degree has negative directions, here of 5e-8 of the largest
    whole = 1e-6 if degree.is_integer() else 2e-5
    assert got == pytest.approx(list(exact(*sample, alpha, 1 / 3, coef0, degree)), abs=whole)


def test_few_landmarks_come_close_and_do_not_depend_on_partitions(table, sample):
    def fit(rows):
        return KernelRidge(inputCols=COLUMNS, labelCol="y", alpha=0.6, degree=1.5, coef0=2.0, landmarks=30).fit(rows)

    model = fit(table)
    assert len(model.marks) == 30
    assert np.abs(np.array(scores(model, table)) - exact(*sample, 0.6, 1 / 3, 2.0, 1.5)).max() < 0.02
    assert fit(table.repartition(7)).marks.tolist() == model.marks.tolist()
    # copies of a row are one landmark
    assert len(KernelRidge(inputCols=COLUMNS, labelCol="y", landmarks=90).fit(table.union(table)).marks) == 90


def test_whitening_leaves_out_dependent_landmarks(table):
    kernel = np.array([[4.0, 4.0, 2.0], [4.0, 4.0, 2.0], [2.0, 2.0, 5.0]])
    maps = whitening(kernel)
    assert maps.shape == (3, 2) and maps.T @ kernel @ maps == pytest.approx(np.eye(2))
    assert polynomial_kernel(np.array([[-3.0]]), np.array([[1.0]]), 1.0, 1.0, 1.5).tolist() == [[0.0]]
    assert polynomial_kernel(np.array([[-3.0]]), np.array([[1.0]]), 1.0, 1.0, 3.0).tolist() == [[-8.0]]
    with pytest.raises(ValueError, match="no rows"):
        KernelRidge(inputCols=COLUMNS, labelCol="y").fit(table.limit(0))
    with pytest.raises(ValueError, match="landmarks"):
        KernelRidge(inputCols=COLUMNS, labelCol="y", landmarks=0).fit(table)
