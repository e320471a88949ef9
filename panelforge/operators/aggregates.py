"""Grouped statistics. Everything that shares a grouping goes into one ``agg``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def mean(c: Column) -> Column:
    """Mean of the non-null values. Decimals are summed exactly before the one division."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are present; null if either is constant.

    ``corr`` raises an error for a constant column, so R² gives the size and the covariance the
    sign. R² is defined as 1 where only ``y`` is constant; no covariance then means no result.
    """
    size, joint = F.regr_r2(y, x), F.covar_samp(x, y)
    constant = (joint == 0) & (size == 1)
    return F.when(~constant, F.signum(joint) * F.sqrt(size))


STATISTICS = {
    "sum": F.sum,
    "mean": mean,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "median": F.median,
    "count": F.count,
    "nunique": F.count_distinct,
}


def statistic_columns(
    columns: Sequence[str], statistics: Sequence[str], pattern: str = "{column}_{stat}"
) -> list[Column]:
    """One aggregate per column and statistic, named by ``pattern``."""
    return [
        STATISTICS[s](F.col(c)).alias(pattern.format(column=c, stat=s))
        for c in columns
        for s in statistics
    ]


def statistics(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    stats: Sequence[str] = ("sum", "mean", "std"),
    pattern: str = "{column}_{stat}",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Wide statistics per key."""
    return df.groupBy(*keys).agg(*statistic_columns(columns, stats, pattern), *extra)


def panel_statistics(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    record_of: str | None = None,
    record_name: str = "record_num",
    marks: Sequence[str] = (),
) -> DataFrame:
    """Sum, mean and sample deviation of every measure per panel cell.

    A single-row cell has deviation 0. ``record_of`` adds the number of its distinct values.
    ``marks`` are 0/1 columns without nulls: their sum and the row count give all three
    statistics, so each needs one aggregation buffer only.
    """
    aggregates = []
    for c in measures:
        aggregates += [
            F.sum(c).alias(f"sum_{c}"),
            mean(F.col(c)).alias(f"mean_{c}"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"std_{c}"),
        ]
    aggregates += [F.sum(c).alias(f"sum_{c}") for c in marks]
    if marks:
        aggregates.append(F.count(F.lit(1)).alias("_rows"))
    if record_of:
        aggregates.append(F.count_distinct(record_of).alias(record_name))
    cells = df.groupBy(*keys).agg(*aggregates)
    if not marks:
        return cells
    n = F.col("_rows").cast("double")
    derived = {}
    for c in marks:
        ones = F.col(f"sum_{c}").cast("double")
        spread = F.try_divide(ones * (n - ones), n * (n - F.lit(1.0)))
        derived[f"mean_{c}"] = ones / n
        derived[f"std_{c}"] = F.coalesce(F.sqrt(spread), F.lit(0.0))
    return cells.withColumns(derived).drop("_rows")


def totals(df: DataFrame, keys: Sequence[str], measure: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(measure).alias(name))


def kind_block(
    df: DataFrame, keys: Sequence[str], kinds: Mapping[str, str], summed: Sequence[str] = ()
) -> DataFrame:
    """Per recoded column: distinct values, non-null rows and (for ``summed``) the code total.

    ``kinds`` maps a column to the prefix of its result names.
    """
    aggregates = []
    for c, prefix in kinds.items():
        aggregates += [
            F.count_distinct(c).alias(f"{prefix}_kinds"),
            F.count(c).alias(f"{prefix}_record_num"),
        ]
        if c in summed:
            aggregates.append(F.sum(c).alias(f"{prefix}_type"))
    return df.groupBy(*keys).agg(*aggregates)


def most_frequent(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value of every column per key; the smallest one on ties.

    Values are counted per (key, column, value) before they meet per key, so a key with very
    many rows or values never sits in one task. A key with only nulls in a column gets null.
    """
    keys, columns = list(keys), list(columns)
    counted = (
        df.select(*keys, *columns)
        .groupingSets([[*keys, c] for c in columns], *keys, *columns)
        .agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_n"))
    )
    width = len(columns)
    best = []
    for i, c in enumerate(columns):
        # every bit of the grouping id is set but the one of this set's own column
        own = F.lit((1 << width) - 1 - (1 << (width - 1 - i)))
        entry = F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v"))
        best.append(
            F.min(F.when((F.col("_set") == own) & F.col(c).isNotNull(), entry))
            .getField("v")
            .alias(c)
        )
    return counted.groupBy(*keys).agg(*best)


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def mean_by(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[mean(F.col(c)).alias(f"mean_{c}") for c in measures])


def rmse(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error, over all rows or per key."""
    error = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def rmsle(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error of the logarithms of ``1 + value``."""
    logs = df.withColumns({"_a": F.log1p(actual), "_p": F.log1p(predicted)})
    return rmse(logs, "_a", "_p", keys).withColumnRenamed("rmse", "rmsle")
