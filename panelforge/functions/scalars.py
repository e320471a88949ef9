"""Scalar expressions: periods, dates, digit runs, text pieces, power transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_offset(period: Column | str, base: int) -> Column:
    """Years between a ``yyyymm`` number and ``base``: (201709, 2011) -> 6."""
    return F.floor(_col(period) / F.lit(100)).cast("int") - F.lit(base)


def period_month(period: Column | str) -> Column:
    """Month of a ``yyyymm`` number, read from its 5th and 6th characters."""
    return F.substring(_col(period).cast("string"), 5, 2).try_cast("int")


def period_of(ts: Column | str) -> Column:
    """``yyyymm`` number of a date or timestamp."""
    return F.year(_col(ts)) * F.lit(100) + F.month(_col(ts))


def parse_period(text: Column | str) -> Column:
    """First day of a ``yyyymm`` value; null if it is not one."""
    return F.to_date(F.try_to_timestamp(_col(text).cast("string"), F.lit("yyyyMM")))


def parse_day(text: Column | str, separator: str = "-") -> Column:
    """Date of ``y-m-d`` text with one- or two-digit month and day; null if it is not one."""
    pattern = F.lit(f"yyyy{separator}M{separator}d")
    return F.to_date(F.try_to_timestamp(_col(text).cast("string"), pattern))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(_col(later), _col(earlier))


def digit_runs(text: Column | str) -> Column:
    """Every run of digits in the text, in order."""
    return F.regexp_extract_all(_col(text), F.lit(r"(\d+)"), 1)


def band_bounds(text: Column | str) -> dict[str, Column]:
    """Bounds of a band such as ``10-15W``: low, high and centre.

    Text with any other number of digit runs than two is a point: all three are its first run.
    """
    runs = digit_runs(text)
    low = F.get(runs, F.lit(0)).try_cast("double")
    high = F.when(F.size(runs) == 2, F.get(runs, F.lit(1)).try_cast("double")).otherwise(low)
    return {"low": low, "high": high, "center": (low + high) / F.lit(2.0)}


def piece_count(text: Column | str) -> Column:
    """Number of pieces after splitting on runs of non-word characters; 0 for null or empty.

    ``(?U)`` makes the word class cover every script, not only ASCII.
    """
    c = _col(text)
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.size(F.split(c, r"(?U)\W+")))


def mentions(text: Column | str, word: str, without: str | None = None) -> Column:
    """Does the text contain ``word`` (and not ``without``)?"""
    c = _col(text)
    found = c.contains(F.lit(word))
    return found & ~c.contains(F.lit(without)) if without is not None else found


def boxcox1p(x: Column | str, lam: float) -> Column:
    """Box-Cox transform of ``1 + x``; ``log1p`` at ``lam = 0``."""
    c = _col(x).cast("double")
    if lam == 0:
        return F.log1p(c)
    return F.expm1(F.lit(float(lam)) * F.log1p(c)) / F.lit(float(lam))


def is_infinite(x: Column | str) -> Column:
    return F.abs(_col(x).cast("double")) == F.lit(float("inf"))


def replace_infinite(x: Column | str, value: float) -> Column:
    c = _col(x).cast("double")
    return F.when(is_infinite(c), F.lit(float(value))).otherwise(c)
