from panelforge.operators import (
    aggregates,
    columns,
    encode,
    entity,
    filters,
    impute,
    joins,
    profile,
    quantiles,
    ranking,
)

__all__ = [
    "aggregates",
    "columns",
    "encode",
    "entity",
    "filters",
    "impute",
    "joins",
    "profile",
    "quantiles",
    "ranking",
]
