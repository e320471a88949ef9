"""Joins. Strategy is left to adaptive execution, which broadcasts a side only when its
measured size is small and splits skewed partitions of the others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import period_month, year_offset
from panelforge.session import pin


def inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on=on, how="inner")


def natural(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every shared column name."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, on=shared, how="inner")


def suffixed(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    how: str = "inner",
) -> DataFrame:
    """Join with the shared non-key columns suffixed on both sides."""
    keys = [on] if isinstance(on, str) else list(on)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, on=keys, how=how)


def align(blocks: Sequence[DataFrame], key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join feature blocks on the entity key (``how='full'`` keeps every entity)."""
    return reduce(lambda a, b: a.join(b, on=key, how=how), blocks)


def enrich(facts: DataFrame, maps: Sequence[DataFrame], on: str, columns: Sequence[str]) -> DataFrame:
    """Union the key projections of several tables and join them to the facts."""
    keys = union_keys(maps, [on, *columns])
    return facts.join(keys, on=on, how="inner")


def union_keys(tables: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column one table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def attach(df: DataFrame, extra: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join: entities without a match get nulls."""
    return df.join(extra, on=on, how="left")


def attach_groups(df: DataFrame, groups: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join of a table with one row per group.

    The groups are written first: their measured size, not a guess from their input, decides
    whether they are broadcast. Where they are, the rows of ``df`` are not shuffled; beyond the
    session's limit adaptive execution splits the hot groups of the join.
    """
    return df.join(pin(groups, "groups"), on=on, how="left")


def member_flag(df: DataFrame, keys: DataFrame, on: str, name: str) -> DataFrame:
    """1 where the key occurs in ``keys``, else 0; rows are neither lost nor repeated."""
    known = keys.select(on).distinct().withColumn(name, F.lit(1))
    return df.join(known, on=on, how="left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def members(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on=on, how="left_semi")


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default=0) -> DataFrame:
    """Value from a table with one row per key, ``default`` for a missing key."""
    found = df.join(table.select(on, value), on=on, how="left")
    return found.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def period_dimension(df: DataFrame, period: str, base: int) -> DataFrame:
    """One row per distinct period with its year offset and month."""
    return (
        df.select(period)
        .distinct()
        .withColumn("year_delta", year_offset(period, base))
        .withColumn("month", period_month(period))
    )
