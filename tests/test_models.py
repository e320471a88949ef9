import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.models import (
    AdaBoostR2,
    AveragingRegressor,
    PenalisedLinear,
    PolynomialRidge,
    QuartileScaler,
    StackingRegressor,
    blend,
    gradient_boosting,
    lasso,
    random_forest,
    sgd_linear,
)
from panelforge.models import validation as va
from panelforge.models.boosting import weighted_median
from panelforge.models.ensemble import predict
from panelforge.models.jobs import kept
from panelforge.models.linear import converged, solver_settings
from panelforge.operators.ranking import shuffled_folds


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (150, 3)) * [1.0, 2.0, 0.5] + [0.0, 3.0, 1.0]
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.4, 150) + 20
    return x, y


@pytest.fixture(scope="module")
def table(spark, sample):
    x, y = sample
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(len(y)))
    return spark.createDataFrame(pdf).cache()


def coordinate_descent(x, y, alpha, rho, rounds=4000):
    x, y = x - x.mean(0), y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(x.shape[1]):
            rest = y - x @ w + x[:, j] * w[j]
            c = x[:, j] @ rest / n
            w[j] = math.copysign(max(abs(c) - alpha * rho, 0), c) / (
                x[:, j] @ x[:, j] / n + alpha * (1 - rho)
            )
    return w


@pytest.mark.parametrize(("alpha", "rho"), [(0.2, 1.0), (0.5, 0.5), (0.7, 0.0), (0.0, 1.0)])
def test_penalised_linear_meets_coordinate_descent(table, sample, alpha, rho):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(table)
    model = PenalisedLinear(alpha=alpha, l1Ratio=rho, labelCol="y").fit(rows)
    assert model.coefficients.toArray() == pytest.approx(
        coordinate_descent(*sample, alpha, rho), abs=1e-5
    )


def test_both_solvers_agree(table, sample, monkeypatch):
    monkeypatch.setattr("panelforge.models.linear.NORMAL_WIDTH", 1)
    assert solver_settings(3)["solver"] == "l-bfgs"
    model = sgd_linear(["a", "b", "c"], "y", "elasticnet", 0.4).fit(table)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(
        coordinate_descent(*sample, 0.4, 0.15), abs=1e-4
    )


def test_lasso_runs_on_robust_scale(table, sample, tmp_path):
    x, y = sample
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    model = lasso(["a", "b", "c"], "y", 0.1).fit(table)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(
        coordinate_descent((x - q[1]) / (q[2] - q[0]), y, 0.1, 1.0), abs=1e-5
    )
    path = str(tmp_path / "scaler")
    model.stages[0].save(path)
    again = type(model.stages[0]).load(path).transform(table).first()["features"]
    assert again.toArray() == pytest.approx(model.stages[0].transform(table).first()["features"].toArray())
    assert QuartileScaler(inputCols=["a"]).getOutputCol() == "features"


def test_polynomial_ridge_is_the_kernel_solution(table, sample):
    """On centred kernels the dual N×N solution and the explicit map agree."""
    x, y = sample
    gamma, coef0, alpha = 1 / 3, 2.5, 0.6
    kernel = (gamma * x @ x.T + coef0) ** 2
    centre = np.eye(len(y)) - 1 / len(y)
    kc = centre @ kernel @ centre
    dual = kc @ np.linalg.solve(kc + alpha * np.eye(len(y)), y - y.mean()) + y.mean()
    model = PolynomialRidge(inputCols=["a", "b", "c"], labelCol="y", alpha=alpha, coef0=coef0).fit(table)
    got = [r["p"] for r in predict(model, table, "p").orderBy("id").collect()]
    assert got == pytest.approx(list(dual), abs=1e-5)


def test_weighted_median(spark):
    def median(pairs):
        votes = F.array(
            *[F.struct(F.lit(v).alias("value"), F.lit(w).alias("weight")) for v, w in pairs]
        )
        total = sum(w for _, w in pairs)
        return spark.range(1).select(weighted_median(votes, total)).first()[0]

    assert median([(3.0, 1.0), (1.0, 1.0), (2.0, 1.0)]) == 2.0
    assert median([(1.0, 5.0), (2.0, 1.0), (9.0, 1.0)]) == 1.0
    assert median([(1.0, 1.0), (9.0, 3.0)]) == 9.0


def test_adaboost_beats_one_tree(table):
    from panelforge.operators.aggregates import rmse

    def error(trees):
        model = AdaBoostR2(inputCols=["a", "b", "c"], labelCol="y", trees=trees, seed=2).fit(table)
        assert 1 <= len(model.members) <= trees
        return rmse(predict(model, table, "p"), "y", "p").first()["rmse"]

    assert error(8) < error(1)


def test_average_and_blend(table):
    members = [sgd_linear(["a"], "y", "l2", 0.0), random_forest(["b"], "y", trees=3, depth=3)]
    parts = table
    for i, m in enumerate(members):
        parts = predict(m.fit(table), parts, f"m{i}")
    model = AveragingRegressor(members).fit(table)
    both = predict(model, parts, "avg").withColumn("want", (F.col("m0") + F.col("m1")) / 2)
    assert both.filter(F.abs(F.col("avg") - F.col("want")) > 1e-9).count() == 0
    df = table.sparkSession.createDataFrame([(10.0, 20.0, 40.0)], "s double, x double, l double")
    assert blend(df, {"s": 0.7, "x": 0.15, "l": 0.15}).first()["blend"] == pytest.approx(16.0)


def test_stacking_sees_every_row_once_out_of_fold(table):
    folded = shuffled_folds(table, ["id"], 5, seed=156)
    stack = StackingRegressor(folds=5).of(
        [sgd_linear(["a"], "y", "l2", 0.0), gradient_boosting(["b"], "y", trees=3)],
        lambda names: sgd_linear(names, "y", "l2", 0.0),
    )
    models = stack.fit_folds(folded)
    unseen = stack.out_of_fold(folded, models)
    assert unseen.count() == 150 and unseen.select("id").distinct().count() == 150
    fold0 = folded.filter("fold = 0")
    mine = predict(stack.bases[0].fit(folded.filter("fold <> 0")), fold0, "want")
    joined = mine.join(unseen.select("id", "base_0"), "id")
    assert joined.count() == fold0.count() > 0
    assert joined.filter(F.abs(F.col("want") - F.col("base_0")) > 1e-9).count() == 0
    scored = predict(stack.fit(folded), folded, "p")
    assert scored.columns == [*folded.columns, "p"] and scored.count() == 150


def test_cross_validation_and_search(table):
    folded = shuffled_folds(table, ["id"], 3, seed=1)
    scores = va.cross_validate(folded, {"one": sgd_linear(["a"], "y"), "two": sgd_linear(["a", "b"], "y")}, "y", folds=3)
    assert scores.count() == 6
    summary = {r["model"]: r["rmse_mean"] for r in va.score_summary(scores).collect()}
    assert summary["two"] < summary["one"]
    estimator = sgd_linear(["a", "b", "c"], "y", "l2")
    alpha = estimator.getStages()[-1].alpha
    table_ = va.grid_search(folded, estimator, [{alpha: 0.001}, {alpha: 1000.0}], "y", folds=3)
    best = table_.filter("best = 1").collect()
    assert len(best) == 1 and best[0]["params"] == '{"alpha": 0.001}' and best[0]["score"] > 0.9
    assert len(va.param_grid(a=(alpha, [1.0, 2.0]))) == 2


def test_elimination_drops_noise_first(spark, table):
    noisy = shuffled_folds(table, ["id"], 3, seed=1).withColumn("noise", F.rand(4))
    steps = va.eliminate_features(
        noisy, ["a", "b", "noise"], "y", lambda names: sgd_linear(names, "y", "l2"), folds=3
    ).orderBy(F.desc("n_features")).collect()
    assert [s["n_features"] for s in steps] == [3, 2, 1]
    assert steps[0]["dropped"] == "noise"
    assert sum(s["selected"] for s in steps) == 1


def test_a_kept_table_is_left_alone(spark):
    df = spark.range(3)
    with kept(df) as outer:
        with kept(outer):
            pass
        assert outer.storageLevel.useMemory
    assert not df.storageLevel.useMemory


def test_ensembles_keep_their_prediction_column(spark, table):
    members = [sgd_linear(["a", "b"], "y"), sgd_linear(["a", "c"], "y")]
    averaged = AveragingRegressor(members)
    averaged._set(predictionCol="mine")
    model = averaged.fit(table)
    assert "mine" in model.transform(table).columns
    assert predict(model, table, "p").columns == [*table.columns, "p"]


def test_unfinished_iterations_are_an_error():
    class Summary:
        totalIterations = 9

    class Model:
        hasSummary, summary = True, Summary()

        def getSolver(self):
            return "l-bfgs"

        def getMaxIter(self):
            return 9

    with pytest.raises(RuntimeError, match="convergence"):
        converged(Model())
