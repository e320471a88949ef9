"""Tables that describe a table: types, gaps, skew, correlation, distribution."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.aggregates import correlation
from panelforge.operators.columns import numeric_columns
from panelforge.operators.moments import pair_moments
from panelforge.operators.ranking import with_position


def _unfold(stats: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return stats.select(F.inline(F.array(*entries)))


def profile(df: DataFrame) -> DataFrame:
    """``(column, type, rows, non_null)`` for every column, from one pass."""
    names = df.columns
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)],
    )
    return _unfold(
        stats,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(df.schema[c].dataType.simpleString()).alias("type"),
                F.col("_rows").alias("rows"),
                F.col(f"_{i}").alias("non_null"),
            )
            for i, c in enumerate(names)
        ],
    )


def preview(df: DataFrame, order: Sequence[str | Column], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top(df: DataFrame, measure: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the largest measure."""
    return df.orderBy(F.col(measure).desc(), *ties).limit(n)


def missing_share(df: DataFrame) -> DataFrame:
    """``(column, missing_pct)`` of the columns that have a null."""
    names = df.columns
    stats = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(names)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.try_divide((F.col("_rows") - F.col(f"_{i}")) * F.lit(100.0), F.col("_rows")).alias(
                "missing_pct"
            ),
        )
        for i, c in enumerate(names)
    ]
    return _unfold(stats, entries).filter(F.col("missing_pct") > 0)


def missing_report(df: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` columns with the largest share of nulls."""
    return top(missing_share(df), "missing_pct", n, ["column"])


def skew_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, skew)`` of the numeric columns; null for a constant one."""
    columns = list(columns or numeric_columns(df))
    stats = df.agg(*[F.skewness(c).alias(c) for c in columns])
    return _unfold(
        stats,
        [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("skew")) for c in columns],
    )


def skewed_columns(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 0.75):
    """Names of the columns whose skewness is beyond ``limit`` (one small row per column)."""
    rows = skew_table(df, columns).filter(F.abs("skew") > limit).select("column").collect()
    found = {r["column"] for r in rows}
    return [c for c in df.columns if c in found]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(col_a, col_b, r)`` for every ordered pair; null where a column is constant or no row has both.

    Pairs use the rows where both columns hold a finite number. One scan gives the moments of all pairs.
    """
    columns = list(columns or numeric_columns(df))
    n = len(columns)
    first = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    pairs = first.select("i", F.explode(F.sequence(F.col("i"), F.lit(n - 1))).alias("j"))
    stats = pairs.join(pair_moments(df, columns), ["i", "j"], "left")
    # a deviation of 1e-12 of the mean is what rounding leaves of a constant
    spread = [F.col(f"ss_{s}") > F.col("n") * F.col(f"mean_{s}") * F.col(f"mean_{s}") * 1e-24 for s in "ij"]
    r = F.when(spread[0] & spread[1], F.col("ss_ij") / F.sqrt("ss_i") / F.sqrt("ss_j"))
    names = F.array(*[F.lit(c) for c in columns])
    half = stats.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))
    once = F.struct(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "r")
    back = F.struct(F.col("b").alias("col_a"), F.col("a").alias("col_b"), "r")
    return half.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(once)).otherwise(F.array(once, back))))


def normal_fit(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation of the normal law closest to a column."""
    return df.agg(F.avg(column).alias("mu"), F.stddev_pop(column).alias("sigma"))


def density_table(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Histogram of a column with equal-width bins: ``(bin, low, high, n, density)``.

    The largest value belongs to the last bin; the densities integrate to 1.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    s = values.agg(
        F.struct(
            F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")
        ).alias("s")
    ).scalar()
    lo, width = s.getField("lo"), (s.getField("hi") - s.getField("lo")) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, width)), F.lit(0))
    counted = (
        values.select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "bin",
        (lo + F.col("bin") * width).alias("low"),
        (lo + (F.col("bin") + 1) * width).alias("high"),
        "n",
        F.try_divide(F.col("n").cast("double"), s.getField("n") * width).alias("density"),
    )


def kernel_density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of a column on an even grid: ``(point, x, density)``.

    The bandwidth follows Scott's rule, and the grid ends ``cut`` bandwidths beyond the values. Each value counts for
    the two grid points around it by its closeness (linear binning), so only sums per point meet the kernel.
    Gaps and values that are not finite are left out; without two different values there are no rows.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v = v AND abs(v) < double('Infinity')")
    wide = F.stddev_samp("v") * F.pow(F.count("v").cast("double"), F.lit(-0.2))
    s = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"), wide.alias("h")).alias("s"))
    s = s.scalar()
    h, start = s.getField("h"), s.getField("lo") - s.getField("h") * cut
    step = (s.getField("hi") - s.getField("lo") + h * (2.0 * cut)) / (points - 1)
    at = (F.col("v") - start) / step
    cells = (
        values.filter(s.getField("hi") > s.getField("lo"))
        .select(at.alias("at"), F.least(F.floor(at), F.lit(points - 2)).cast("int").alias("cell"))
        .groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("at") - F.col("cell")).alias("right"))
    )
    left = F.struct(F.col("cell"), (F.col("n") - F.col("right")).alias("weight"))
    right = F.struct((F.col("cell") + 1).alias("cell"), F.col("right").alias("weight"))
    weights = cells.select(F.inline(F.array(left, right))).groupBy("cell").agg(F.sum("weight").alias("weight"))
    spread = weights.select("cell", "weight", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    away = (F.col("point") - F.col("cell")) * step / h
    mass = F.sum(F.col("weight") * F.exp(away * away * -0.5))
    return spread.groupBy("point").agg(mass.alias("mass")).select(
        "point",
        (start + F.col("point") * step).alias("x"),
        (F.col("mass") / (s.getField("n") * h * math.sqrt(2.0 * math.pi))).alias("density"),
    )


# Coefficients of the rational approximation of the inverse normal
# distribution function published by P. J. Acklam (relative error below 1.15e-9).
_CENTRE_NUM = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
               1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_CENTRE_DEN = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
               6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL_NUM = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_TAIL_DEN = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0]
_TAIL = 0.02425


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def with_inverse_normal(df: DataFrame, probability: str, name: str) -> DataFrame:
    """Add the standard normal quantile of a probability column."""
    p, t, q, r = (F.col(c) for c in (probability, "_t", "_q", "_r"))
    # the steps are separate columns: inlined, they would repeat in every polynomial term
    steps = df.withColumns(
        {"_t": F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p))), "_q": p - F.lit(0.5)}
    ).withColumn("_r", q * q)
    tail = _polynomial(_TAIL_NUM, t) / _polynomial(_TAIL_DEN, t)
    centre = q * _polynomial(_CENTRE_NUM, r) / _polynomial(_CENTRE_DEN, r)
    value = F.when(p < _TAIL, tail).when(p > 1 - _TAIL, -tail).otherwise(centre)
    return steps.withColumn(name, value).drop("_t", "_q", "_r")


def normal_quantiles(df: DataFrame, column: str, key: str) -> DataFrame:
    """``(key, value, theoretical)``: each value beside its normal order statistic (Filliben)."""
    values = df.select(key, F.col(column).cast("double").alias("value")).filter(
        F.col("value").isNotNull()
    )
    placed = with_position(values, [F.col("value"), F.col(key)], "_i", label="quantiles")
    n = float(values.count())
    last = 0.5 ** (1.0 / n) if n else 0.5
    position = (
        F.when(F.col("_i") == n, F.lit(last))
        .when(F.col("_i") == 1, F.lit(1.0 - last))
        .otherwise((F.col("_i") - F.lit(0.3175)) / F.lit(n + 0.365))
    )
    with_p = placed.withColumn("_p", position)
    return with_inverse_normal(with_p, "_p", "theoretical").select(key, "value", "theoretical")


def normal_line(quantiles: DataFrame) -> DataFrame:
    """Least-squares line through a normal quantile table and its correlation."""
    x, y = F.col("theoretical"), F.col("value")
    return quantiles.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        correlation(x, y).alias("r"),
    )
