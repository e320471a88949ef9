"""Row positions and folds over a whole table, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import pin

# monotonically_increasing_id keeps the partition number above the 33rd bit
_ROW_BITS = 33


def with_position(df: DataFrame, order: Sequence[Column], name: str, label: str = "position") -> DataFrame:
    """Add the 1-based position of each row in ``order``, which must be a total order.

    The rows are range-sorted and numbered inside their partitions; the offset of a partition
    is the number of rows before it. The sorted rows are written to scratch storage first, so
    the numbers stay put if an executor is lost. Only one count per partition goes through one
    task, and that list is as long as the shuffle has partitions.
    """
    numbered = pin(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned(F.col("_mid"), _ROW_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), on="_part")
        .withColumn(name, F.col("_offset") + row + F.lit(1))
        .drop("_part", "_offset", "_mid")
    )


def rank_entities(totals: DataFrame, measure: str, key: str, name: str) -> DataFrame:
    """Rank entities by a total: the smallest gets 1, the largest gets N.

    Equal totals are ordered by falling key. ``totals`` has one row per entity.
    """
    order = [F.col(measure).asc_nulls_first(), F.col(key).desc()]
    return with_position(totals, order, name, label="rank")


def contiguous_folds(
    df: DataFrame, order: Sequence[Column], k: int, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 by position: the first ``n mod k`` folds hold one row more."""
    placed = with_position(df, order, "_position", label="folds")
    size, longer = divmod(placed.select(F.max("_position")).first()[0] or 0, k)
    at, edge = F.col("_position") - F.lit(1), longer * (size + 1)
    fold = F.when(at < edge, F.floor(at / F.lit(size + 1))).otherwise(
        F.lit(longer) + F.floor((at - F.lit(edge)) / F.lit(max(size, 1)))
    )
    return placed.withColumn(name, fold.cast("int")).drop("_position")


def shuffle_key(keys: Sequence[str], seed: int) -> Column:
    """A reproducible pseudo-random text per row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def shuffled_folds(
    df: DataFrame, keys: Sequence[str], k: int, seed: int, name: str = "fold"
) -> DataFrame:
    """Fold 0..k-1 after a seeded shuffle; fold sizes differ by at most one."""
    keyed = df.withColumn("_shuffle", shuffle_key(keys, seed))
    order = [F.col("_shuffle"), *[F.col(c) for c in keys]]
    return contiguous_folds(keyed, order, k, name).drop("_shuffle")


def hash_fraction(keys: Sequence[str], seed: int) -> Column:
    """A reproducible number in [0, 1) per row key."""
    head = F.substring(shuffle_key(keys, seed), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 32))


def random_splits(
    df: DataFrame, keys: Sequence[str], train: float = 0.7, splits: int = 10, seed: int = 0
) -> DataFrame:
    """Add ``split_0 … split_{splits-1}``: 1 marks a training row of that split."""
    marks = {
        f"split_{i}": (hash_fraction(keys, seed + i) < F.lit(train)).cast("int")
        for i in range(splits)
    }
    return df.withColumns(marks)
