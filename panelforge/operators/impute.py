"""Missing-value fills. Column-wide fills are scalar subqueries: no join, nothing collected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.aggregates import most_frequent
from panelforge.operators.joins import attach_groups
from panelforge.operators.quantiles import exact_medians


def filled_with(df: DataFrame, column: str, value: Any) -> Column:
    """The column with its nulls filled; a text fill turns a column of another type into text."""
    kept = F.col(column)
    if isinstance(value, str) and not isinstance(df.schema[column].dataType, T.StringType):
        kept = kept.cast("string")
    return F.coalesce(kept, F.lit(value))


def fill_constant(df: DataFrame, values: Mapping[str, Any]) -> DataFrame:
    """Fill nulls with one value per column; numeric fills keep the column's type."""
    texts = {c: filled_with(df, c, v) for c, v in values.items() if isinstance(v, str)}
    others = {c: v for c, v in values.items() if not isinstance(v, str)}
    out = df.fillna(others) if others else df
    return out.withColumns(texts) if texts else out


def fill_rest(df: DataFrame, value: float = 0) -> DataFrame:
    """Fill every remaining null of the numeric columns."""
    return df.fillna(value)


def _one_row(stats: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    row = stats.select(F.struct(*columns).alias("_row")).scalar()
    return {c: row.getField(c) for c in columns}


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return _one_row(df.agg(*[F.avg(c).alias(c) for c in columns]), columns)


def column_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return _one_row(most_frequent(df, [], columns), columns)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = column_means(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), means[c]) for c in columns})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the most frequent value, the smallest one on ties."""
    modes = column_modes(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), modes[c]) for c in columns})


def fill_group_median(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Fill with the median of the row's group; an all-null group stays null.

    The medians are joined back instead of taken over a window: a window would gather every
    row of a large group in one task.
    """
    names = {c: f"_median_{c}" for c in columns}
    medians = exact_medians(df, [group], columns).withColumnsRenamed(names)
    joined = attach_groups(df, medians, group)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(m)) for c, m in names.items()}
    return joined.withColumns(filled).select(*df.columns)


def fill_deviation(c: Column) -> Column:
    """Deviation of a single-row group counts as 0."""
    return F.coalesce(c, F.lit(0.0))


@dataclass(frozen=True)
class FillPolicy:
    """Which fill each column gets.

    ``constant``      column -> value
    ``mode``          columns filled with their most frequent value
    ``group_median``  column -> grouping column
    ``drop``          columns removed
    """

    constant: Mapping[str, Any] = field(default_factory=dict)
    mode: Sequence[str] = ()
    group_median: Mapping[str, str] = field(default_factory=dict)
    drop: Sequence[str] = ()


def apply_policy(df: DataFrame, policy: FillPolicy) -> DataFrame:
    """Apply a whole fill policy: one projection, plus one join per median grouping.

    Statistics come from the columns as they were before any fill.
    """
    order = [c for c in df.columns if c not in policy.drop]
    modes = column_modes(df, policy.mode) if policy.mode else {}
    filled = {c: F.coalesce(F.col(c), m) for c, m in modes.items()}
    for c, value in policy.constant.items():
        filled[c] = filled_with(df, c, value)
    out = df
    for group in sorted(set(policy.group_median.values())):
        columns = [c for c, g in policy.group_median.items() if g == group]
        out = fill_group_median(out, group, columns)
    return out.withColumns(filled).select(*order) if filled else out.select(*order)
