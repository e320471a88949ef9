from panelforge.catalog import (  # noqa: F401  (importing a module registers its queries)
    aggregations,
    cleaning,
    encodings,
    entities,
    forecasts,
    relations,
    rows,
    scalars,
    tables,
)
from panelforge.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
