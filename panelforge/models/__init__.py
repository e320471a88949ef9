from panelforge.models.boosting import AdaBoostR2
from panelforge.models.ensemble import AveragingRegressor, StackingRegressor, blend
from panelforge.models.huber import HuberBoosting
from panelforge.models.kernel import KernelRidge
from panelforge.models.linear import PenalisedLinear, PolynomialRidge, elastic_net, lasso, sgd_linear
from panelforge.models.scaling import QuartileScaler
from panelforge.models.second_order import SecondOrderBooster, leaf_wise_boosting, second_order_boosting
from panelforge.models.trees import gradient_boosting, histogram_boosting, random_forest, regularised_boosting

__all__ = [
    "AdaBoostR2",
    "AveragingRegressor",
    "HuberBoosting",
    "KernelRidge",
    "PenalisedLinear",
    "PolynomialRidge",
    "QuartileScaler",
    "SecondOrderBooster",
    "StackingRegressor",
    "blend",
    "elastic_net",
    "gradient_boosting",
    "histogram_boosting",
    "lasso",
    "leaf_wise_boosting",
    "random_forest",
    "regularised_boosting",
    "second_order_boosting",
    "sgd_linear",
]
