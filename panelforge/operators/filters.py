"""Row filters and splits. A null comparison counts as false, also under negation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import period_month


def holds(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def keep_months(df: DataFrame, period: str, months: Sequence[int] = (9, 10, 11)) -> DataFrame:
    """Rows whose ``yyyymm`` period falls in one of the months."""
    return df.filter(period_month(period).isin(*months))


def drop_where_any(df: DataFrame, values: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Drop rows where any listed column holds one of its listed values."""
    hit = F.lit(False)
    for name, listed in values.items():
        hit = hit | holds(F.col(name).isin(*listed))
    return df.filter(~hit)


def after(df: DataFrame, column: str, threshold: Any) -> DataFrame:
    return df.filter(F.col(column) > F.lit(threshold))


def drop_where(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(~holds(predicate))


def split_where(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The rows matching the predicate and all the others."""
    return df.filter(holds(predicate)), df.filter(~holds(predicate))


def union_tagged(parts: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    """Union by name with the origin of every row in ``tag``."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def take_tagged(df: DataFrame, name: str, tag: str = "split") -> DataFrame:
    return df.filter(F.col(tag) == F.lit(name)).drop(tag)


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def beyond(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.filter(F.abs(F.col(column)) > F.lit(threshold))


def drop_zero(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != 0)
