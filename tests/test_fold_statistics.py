import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.models import lasso, sgd_linear
from panelforge.models import validation as va
from panelforge.models.fold_statistics import FoldStatistics, linear_terms


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 4)) * [1.0, 5.0, 0.2, 30.0] + [0.0, 100.0, -3.0, 1e4]
    x[:, 3] += 8.0 * x[:, 0]
    y = 3.0 * x[:, 0] - 0.7 * x[:, 1] + 0.01 * x[:, 3] + rng.normal(size=300)
    data = [(*map(float, r), float(v), i % 4) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, "a double, b double, c double, d double, y double, fold int").cache()


@pytest.mark.parametrize("penalty", ["l2", "l1", "elasticnet"])
@pytest.mark.parametrize("alpha", [0.0, 0.05, 2.0])
def test_scores_are_those_of_single_fits(rows, penalty, alpha):
    estimator = sgd_linear(["a", "b", "c", "d"], "y", penalty, alpha)
    found = va.fold_scores(rows, [estimator], "y", "fold", 4, "r2")[0]
    assert found[2] == pytest.approx(va.fold_score(rows, estimator, "y", "fold", 2, "r2"), abs=1e-6)
    rmse = va.fold_scores(rows, [estimator], "y", "fold", 4, "rmse")[0]
    assert rmse[1] == pytest.approx(va.fold_score(rows, estimator, "y", "fold", 1), rel=1e-5)


def test_elimination_takes_one_scan(rows, spark):
    table = va.eliminate_features(rows, ["a", "b", "c", "d"], "y", lambda names: sgd_linear(names, "y", "l2", 0.0), folds=4)
    steps = [tuple(r) for r in table.orderBy(F.desc("n_features")).collect()]
    left = ["a", "b", "c", "d"]
    for n, names, dropped, rmse, _ in steps:
        assert (n, names) == (len(left), ",".join(left))
        estimator = sgd_linear(left, "y", "l2", 0.0)
        by_hand = np.mean([va.fold_score(rows, estimator, "y", "fold", i) for i in range(4)])
        assert rmse == pytest.approx(by_hand, rel=1e-6)
        if dropped:
            weights = va.importances(estimator.fit(rows))
            assert dropped == left[int(np.argmin(weights))]
            left.remove(dropped)
    assert len(left) == 1


def test_gaps_raise_and_other_estimators_are_fitted(rows):
    gapped = rows.withColumn("a", F.when(F.col("a") > -1, F.col("a")))
    with pytest.raises(ValueError, match="gaps"):
        FoldStatistics(gapped, ["a", "b"], "y", "fold", 4)
    assert linear_terms(lasso(["a"], "y", 1.0), rows) is None
    assert linear_terms(sgd_linear(["a"], "y", "l1", 1.0), rows).l1_ratio == 1.0


def test_folds_without_rows_have_no_score(rows):
    statistics = FoldStatistics(rows, ["a"], "y", "fold", 5)
    assert statistics.score(linear_terms(sgd_linear(["a"], "y"), rows), 4) is None
