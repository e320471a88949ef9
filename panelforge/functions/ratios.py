"""Division with stated results for a zero divisor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.scalars import _col


def safe_ratio(num: Column | str, den: Column | str, over_zero: float = 2.0) -> Column:
    """``num / den``; ``over_zero`` for a non-zero number over zero, 0 for 0/0 or a null."""
    n, d = _col(num), _col(den)
    ratio = F.when(d != 0, F.try_divide(n, d)).when(n != 0, F.lit(float(over_zero)))
    return F.coalesce(ratio, F.lit(0.0))


def share(num: Column | str, den: Column | str) -> Column:
    """``num / den`` with 0 for a zero divisor or a null."""
    return F.coalesce(F.try_divide(_col(num), _col(den)), F.lit(0.0))


def null_as_zero_sum(*cols: Column | str) -> Column:
    """Row-wise sum that skips nulls."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(_col(c), F.lit(0.0))
    return total
