"""House prices: from raw listings to a model-ready table and a price per listing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.columns import numeric_columns, total
from panelforge.operators.encode import label_codes, one_hot, unskew
from panelforge.operators.filters import drop_where, take_tagged, union_tagged
from panelforge.operators.impute import FillPolicy, apply_policy
from panelforge.plans import presets
from panelforge.session import pin


@dataclass(frozen=True)
class ListingRoles:
    """How the listing columns are treated."""

    key: str
    target: str
    policy: FillPolicy
    as_text: Sequence[str] = ()
    coded: Sequence[str] = ()
    total_name: str = "TotalSF"
    total_of: Sequence[str] = ()
    skew_limit: float = 0.75
    power: float = 0.15
    extra_keys: Sequence[str] = field(default_factory=tuple)


HOUSES = ListingRoles(
    key="Id",
    target=presets.HOUSE_TARGET,
    policy=presets.HOUSE_POLICY,
    as_text=presets.HOUSE_AS_TEXT,
    coded=presets.HOUSE_CODED,
    total_of=presets.HOUSE_TOTAL_AREA,
)


def house_outlier() -> Column:
    return (F.col("GrLivArea") > presets.HOUSE_OUTLIER_AREA) & (
        F.col(presets.HOUSE_TARGET) < presets.HOUSE_OUTLIER_PRICE
    )


def listing_features(
    train: DataFrame, test: DataFrame, roles: ListingRoles, outlier: Column | None = None
) -> DataFrame:
    """Both tables through the same treatment, told apart by ``split``.

    outlier filter, log target, union, fills, text casts, codes, total area, unskewing, one-hot.
    Keys and target are never filled, coded or transformed.
    """
    if outlier is not None:
        train = drop_where(train, outlier)
    train = train.withColumn(roles.target, F.log1p(roles.target))
    test = test.drop(roles.target)
    rows = union_tagged({"train": train, "test": test})
    held = [roles.key, roles.target, "split", *roles.extra_keys]
    filled = apply_policy(rows, roles.policy)
    texts = {c: F.col(c).cast("string") for c in roles.as_text if c in filled.columns}
    # the vocabulary and the skew test read this table again: it is computed once
    cleaned = pin(filled.withColumns(texts), "listings")
    coded = label_codes(cleaned, [c for c in roles.coded if c in cleaned.columns])
    if roles.total_of:
        coded = coded.withColumn(roles.total_name, total(*roles.total_of))
    numbers = [c for c in numeric_columns(coded) if c not in held]
    straight = unskew(coded, numbers, roles.power, roles.skew_limit)
    categories = [
        f.name for f in straight.schema if f.dataType.typeName() == "string" and f.name not in held
    ]
    return one_hot(straight, categories) if categories else straight


def train_and_test(features: DataFrame, roles: ListingRoles) -> tuple[DataFrame, DataFrame]:
    return take_tagged(features, "train"), take_tagged(features, "test").drop(roles.target)


def prices(predictions: DataFrame, key: str, prediction: str, name: str) -> DataFrame:
    """Predicted prices on their own scale again."""
    return predictions.select(key, F.expm1(prediction).alias(name))
