"""Sales panel: from dated sales records to a forecast per class.

    records -> clean -> one-hot -> panel per (class, year, month) -> class rank -> fit -> predict
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import period_month, year_offset
from panelforge.models.ensemble import predict
from panelforge.models.jobs import kept, side_by_side
from panelforge.operators.aggregates import panel_statistics, totals
from panelforge.operators.columns import numeric_columns
from panelforge.operators.encode import one_hot
from panelforge.operators.filters import after, split_where
from panelforge.operators.joins import union_all
from panelforge.operators.ranking import rank_entities
from panelforge.plans import presets
from panelforge.session import pin


@dataclass(frozen=True)
class PanelRoles:
    """Column roles of a sales table."""

    entity: str = "class_id"
    period: str = "sale_date"
    target: str = "sale_quantity"
    categories: Sequence[str] = field(default_factory=tuple)
    measures: Sequence[str] = field(default_factory=tuple)
    base_year: int = 2011
    first_period: int | None = None  # keep only later periods
    words: Mapping[str, list] | None = None  # category values, if known beforehand


CELL = ["class_trans", "year_delta", "month"]


def gather_records(
    sales: DataFrame, requests: DataFrame | None, roles: PanelRoles, renames: dict | None = None
) -> DataFrame:
    """Recent sales plus the rows to predict, under one set of names."""
    recent = after(sales, roles.period, roles.first_period) if roles.first_period else sales
    if requests is None:
        return recent
    return union_all([recent, requests.withColumnsRenamed(renames or {})])


def vehicle_records(records: DataFrame) -> DataFrame:
    """Cleaned vehicle records with price bounds and body volume."""
    return presets.add_car_volume(presets.add_price_bounds(presets.clean_vehicle_columns(records)))


def vehicle_roles(records: DataFrame) -> PanelRoles:
    """Roles of the vehicle columns; ``records`` is the output of ``vehicle_records``."""
    derived = ["price_level_low", "price_level_high", "price_level_center", "car_volume"]
    present = [c for c in [*presets.VEHICLE_MEASURES, *derived] if c in records.columns]
    return PanelRoles(
        categories=presets.VEHICLE_CATEGORIES, measures=present, base_year=2011, first_period=201607
    )


def panel_cells(records: DataFrame, roles: PanelRoles) -> DataFrame:
    """Statistics of every measure and category mark per (entity, period), written once.

    This is the only pass over all records (one more reads the categories if their vocabulary
    is not given); ranks and forecasts start from these cells.
    """
    keep = [roles.entity, roles.period, roles.target, *roles.measures]
    chosen = records.select(*keep, *roles.categories)
    coded = one_hot(chosen, roles.categories, words=roles.words)
    keys = [roles.entity, roles.period]
    measures = [c for c in numeric_columns(chosen) if c not in [*keys, *roles.categories]]
    marks = [c for c in coded.columns if c not in chosen.columns]
    cells = panel_statistics(coded, keys, measures, record_of=roles.target, marks=marks)
    return pin(cells, "panel-cells")


def class_ranks(cells: DataFrame, roles: PanelRoles) -> DataFrame:
    """``(entity, class_trans)``: N for the largest total of the target, 1 for the smallest."""
    sums = totals(cells, [roles.entity], f"sum_{roles.target}", "_total")
    return rank_entities(sums, "_total", roles.entity, "class_trans").drop("_total")


def panel_table(cells: DataFrame, roles: PanelRoles, ranks: DataFrame) -> DataFrame:
    """One row per (class rank, year offset, month)."""
    dated = cells.withColumns(
        {
            "year_delta": year_offset(roles.period, roles.base_year),
            "month": period_month(roles.period),
        }
    )
    ranked = dated.join(ranks, on=roles.entity).drop(roles.entity, roles.period)
    return ranked.select(*CELL, *[c for c in ranked.columns if c not in CELL])


def build_panel(records: DataFrame, roles: PanelRoles) -> tuple[DataFrame, DataFrame]:
    """The panel and the class ranks of a set of records."""
    cells = panel_cells(records, roles)
    ranks = class_ranks(cells, roles)
    return panel_table(cells, roles, ranks), ranks


@dataclass(frozen=True)
class PanelSplit:
    """A panel cut into the month to predict and all the others."""

    train: DataFrame
    predict: DataFrame
    features: list[str]
    label: str


def split_panel(panel: DataFrame, roles: PanelRoles, year_delta: int, month: int) -> PanelSplit:
    """Separate one month; no statistic of the target is left among the features."""
    wanted = (F.col("year_delta") == year_delta) & (F.col("month") == month)
    asked, train = split_where(panel, wanted)
    features = [c for c in numeric_columns(panel) if roles.target not in c]
    return PanelSplit(train, asked, features, f"sum_{roles.target}")


def fit_predict(split: PanelSplit, models: dict[str, Estimator]) -> DataFrame:
    """Predictions of each model for the asked month, one column per model."""
    with kept(split.train) as rows:
        fitted = side_by_side(
            rows.sparkSession, [lambda e=e: e.fit(rows) for e in models.values()]
        )
    scored = split.predict
    for name, model in zip(models, fitted, strict=True):
        scored = predict(model, scored, name)
    return scored.select(*CELL, *models)


def submission(
    predictions: DataFrame,
    ranks: DataFrame,
    requests: DataFrame,
    prediction: str,
    entity: str = "class_id",
    period: str = "predict_date",
    name: str = "predict_quantity",
) -> DataFrame:
    """Requested keys with the prediction of their class, joined by key."""
    by_class = predictions.select("class_trans", F.col(prediction).alias(name))
    named = by_class.join(ranks, on="class_trans").drop("class_trans")
    return requests.select(period, entity).join(named, on=entity).select(period, entity, name)
