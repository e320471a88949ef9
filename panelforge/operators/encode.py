"""Category encodings and numeric scaling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.scalars import boxcox1p
from panelforge.operators.columns import numeric_columns, string_columns
from panelforge.operators.profile import skewed_columns
from panelforge.operators.quantiles import exact_quantiles
from panelforge.operators.ranking import with_position

def vocabulary(
    df: DataFrame, columns: Sequence[str], max_categories: int = 5_000
) -> dict[str, list]:
    """Sorted distinct non-null values of each column, from one pass.

    The list comes to the driver because it decides the columns of a result; more than
    ``max_categories`` values in all raise an error, since every one becomes a column.
    """
    columns = list(columns)
    sets = df.select(*columns).groupingSets([[c] for c in columns], *columns)
    seen = sets.agg(F.grouping_id().alias("_set")).limit(max_categories + len(columns) + 1)
    rows = seen.collect()
    if len(rows) > max_categories + len(columns):
        raise ValueError(f"more than {max_categories} categories in {columns}")
    found: dict[str, list] = {c: [] for c in columns}
    for row in rows:
        for c in columns:
            if row[c] is not None:
                found[c].append(row[c])
    return {c: sorted(v) for c, v in found.items()}


def one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    words: Mapping[str, list] | None = None,
    keep: bool = False,
    max_categories: int = 5_000,
) -> DataFrame:
    """A 0/1 column ``column_value`` per category; a null gives all zeros.

    By default every string column is encoded. Pass ``words`` to share one vocabulary between
    tables; ``keep`` retains the raw columns. A table that would become wider than
    ``max_categories`` more columns is an error.
    """
    columns = list(columns if columns is not None else string_columns(df))
    words = words or vocabulary(df, columns, max_categories)
    marks = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in words[c]
    ]
    rest = [c for c in df.columns if keep or c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in rest], *marks)


def label_codes(
    df: DataFrame, columns: Sequence[str], words: Mapping[str, list] | None = None
) -> DataFrame:
    """Replace each column by the 0-based place of its value in sorted order.

    The distinct values of all columns, from one pass, are numbered by one range sort and joined
    back column by column; their number has no bound. A null stays null, and so does a value that
    is not in ``words``.
    """
    columns = list(columns)
    out = df
    if not columns:
        return out
    if words is None:
        sets = df.select(*columns).groupingSets([[c] for c in columns], *columns)
        present = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in columns])
        seen = sets.agg(F.grouping_id().alias("_set")).where(present)
        seen = with_position(seen, [F.col("_set"), *[F.col(c) for c in columns]], "_place", "codes")
        first = seen.groupBy("_set").agg(F.min("_place")).collect()  # one row per column
        first = {r[0]: r[1] for r in first}
    for i, c in enumerate(columns):
        if words is None:
            # a grouping set is named by the columns it leaves out, the first one highest
            name = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
            codes = seen.where(F.col("_set") == name)
            codes = codes.select(c, (F.col("_place") - F.lit(first.get(name, 0))).cast("int").alias("_code"))
        else:
            listed = F.array(*[F.lit(v) for v in words[c]])
            codes = df.sparkSession.range(1).select(F.posexplode(listed).alias("_code", c))
        out = out.join(codes, on=c, how="left").drop(c).withColumnRenamed("_code", c)
    return out.select(*df.columns)


def unskew(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    lam: float = 0.15,
    limit: float = 0.75,
) -> DataFrame:
    """Box-Cox transform (of ``1 + x``) of the columns whose skewness is beyond ``limit``."""
    chosen = skewed_columns(df, columns, limit)
    return df.withColumns({c: boxcox1p(c, lam) for c in chosen})


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x − median) / (third − first quartile)``; a zero range divides by 1."""
    columns = list(columns)
    row = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75]).first()
    scaled = {}
    for c in columns:
        if row is None or row[c] is None or row[c][1] is None:
            continue  # nothing but nulls to scale
        first, middle, third = row[c]
        scaled[c] = (F.col(c) - F.lit(middle)) / F.lit((third - first) or 1.0)
    return df.withColumns(scaled)


def features_and_target(
    df: DataFrame, target: str, drop_pattern: str, keys: Sequence[str] = ()
) -> tuple[list[str], str]:
    """Feature names: every numeric column that does not match the pattern of target columns."""
    names = [c for c in numeric_columns(df) if not re.search(drop_pattern, c)]
    return [c for c in names if c != target and c not in keys], target
