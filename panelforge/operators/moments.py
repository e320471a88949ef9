"""Counts, means and centred products of all pairs of columns, from one scan.

Every partition multiplies its blocks of values and of marks for what is present, so a row is never expanded to
one row per pair. What a partition found is one row per pair; these meet once, by pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCHEMA = "g long, i int, j int, n double, mean_i double, mean_j double, ss_i double, ss_j double, ss_ij double"
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]
#: Squares below this share of what they are the difference of are rounding errors.
_NOISE = 1e-13


class _Sums:
    """Sums over one partition's rows of one group, relative to the first value of each column."""

    def __init__(self, width: int):
        self.shift = np.full(width, np.nan)
        self.n, self.x, self.xx, self.xy = (np.zeros((width, width)) for _ in range(4))

    def add(self, values: np.ndarray) -> None:
        present = np.isfinite(values)
        for c in np.flatnonzero(np.isnan(self.shift) & present.any(axis=0)):
            self.shift[c] = values[present[:, c].argmax(), c]
        centred, marks = np.where(present, values - self.shift, 0.0), present.astype(float)
        self.n += marks.T @ marks
        self.x += centred.T @ marks
        self.xx += (centred * centred).T @ marks
        self.xy += centred.T @ centred

    def rows(self, group: int) -> pa.RecordBatch:
        i, j = np.nonzero(np.triu(self.n > 0))
        n, one, two = self.n[i, j], self.x[i, j], self.x[j, i]
        squares = []
        for total, part in ((self.xx[i, j], one), (self.xx[j, i], two)):
            left = total - part * part / n
            squares.append(np.where(left > _NOISE * total, left, 0.0))
        columns = [np.full(len(i), group), i.astype(np.int32), j.astype(np.int32), n]
        columns += [self.shift[i] + one / n, self.shift[j] + two / n, *squares, self.xy[i, j] - one * two / n]
        return pa.record_batch([pa.array(c) for c in columns], names=_NAMES)


def _partition_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, _Sums] = {}
    for batch in batches:
        groups = batch.column(0).to_numpy(zero_copy_only=False)
        columns = [pc.fill_null(c, float("nan")).to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        values = np.stack(columns, axis=1)
        for group in np.unique(groups).tolist():
            if group not in found:
                found[group] = _Sums(values.shape[1])
            found[group].add(values[groups == group])
    for group, sums in found.items():
        yield sums.rows(group)


def pair_moments(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """``g, i, j, n, mean_i, mean_j, ss_i, ss_j, ss_ij`` for each pair of column numbers ``i <= j``.

    A pair uses the rows where both columns hold a finite number: null, NaN and infinite values are gaps. ``ss_*``
    are sums of products of deviations from the means over those rows. ``g`` is the whole number in ``by`` (few
    values, such as folds; rows without one are left out) or 0. Pairs without such rows are absent.
    """
    group = F.lit(0) if by is None else F.col(by)
    plain = df.select(group.cast("long").alias("_g"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    parts = plain.where("_g IS NOT NULL").mapInArrow(_partition_moments, _SCHEMA)
    # means relative to the least one, so that equal ones leave no rounding error
    pair = Window.partitionBy("g", "i", "j")
    for side in "ij":
        mean, least = F.col(f"mean_{side}"), F.col(f"least_{side}")
        parts = parts.withColumn(f"least_{side}", F.min(mean).over(pair))
        share = F.sum(F.col("n") * (mean - least)).over(pair) / F.sum("n").over(pair)
        parts = parts.withColumn(f"all_{side}", least + share)
    off_i, off_j = F.col("mean_i") - F.col("all_i"), F.col("mean_j") - F.col("all_j")
    return parts.groupBy("g", "i", "j").agg(
        F.sum("n").alias("n"),
        F.first("all_i").alias("mean_i"),
        F.first("all_j").alias("mean_j"),
        F.sum(F.col("ss_i") + F.col("n") * off_i * off_i).alias("ss_i"),
        F.sum(F.col("ss_j") + F.col("n") * off_j * off_j).alias("ss_j"),
        F.sum(F.col("ss_ij") + F.col("n") * off_i * off_j).alias("ss_ij"),
    )
