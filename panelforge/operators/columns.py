"""Choosing, dropping, renaming and deriving columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last``, both included."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def drop_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*column_range(df, first, last))


def drop_ranges(df: DataFrame, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    for first, last in ranges:
        df = drop_range(df, first, last)
    return df


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose name contains a match of ``pattern``."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}_{c}" for c in df.columns if c not in keep})


def add_suffix(df: DataFrame, suffix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in keep})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _is_nonzero(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.coalesce(c, F.lit(0)) != 0
    return c.isNotNull()


def nonzero_flags(df: DataFrame) -> DataFrame:
    """One row ``(column, nonzero)`` per column: 1 if it holds anything but nulls and zeros."""
    flags = df.agg(
        *[F.max(_is_nonzero(df, c).cast("int")).alias(c) for c in df.columns]
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("nonzero"))
        for c in df.columns
    ]
    return flags.select(F.inline(F.array(*entries)))


def nonzero_columns(df: DataFrame) -> list[str]:
    """Names of the columns that hold anything but nulls and zeros (one pass, one row back)."""
    row = df.agg(*[F.max(_is_nonzero(df, c).cast("int")).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c]]


def common_columns(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names in both lists, in the order of the left one."""
    present = set(right)
    return [c for c in left if c in present]


def common_nonzero(left: DataFrame, right: DataFrame) -> list[str]:
    return common_columns(nonzero_columns(left), nonzero_columns(right))


def complete_columns(df: DataFrame) -> list[str]:
    """Names of the columns without a null."""
    row = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns])
    counts = row.first()
    return [c for c in df.columns if counts[c] == 0]


def numeric_complete(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus every numeric column without a null."""
    numbers = [c for c in numeric_columns(df) if c not in keep]
    complete = complete_columns(df.select(*numbers)) if numbers else []
    return df.select(*keep, *complete)


def product(*cols: str, scale: float = 1.0) -> Column:
    """Product of columns over ``scale``; null if any is null."""
    out = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        out = out * F.col(c)
    return out / F.lit(float(scale)) if scale != 1.0 else out


def total(*cols: str) -> Column:
    """Sum of columns; null if any is null."""
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out
