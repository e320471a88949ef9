"""Vectors of an embedding table that can be computed with."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import pick


def clean_vectors(table: DataFrame, nonzero: bool = False) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` of the rows whose vector can take part, and its number of entries.

    Null and empty vectors go, those with a null or non-finite entry, and with ``nonzero`` those of zeros only. Of
    vectors of several lengths those of the most frequent length stay (ties: the shorter one), as others cannot be
    compared with them. A table without such vectors has length 0. Other columns are not looked at.
    """
    rows = pick(table, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = rows.where(F.col("embedding").isNotNull() & finite)
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda c: c != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where("n > 0")
    first = lengths.orderBy(F.desc("rows"), "n").first()
    length = first.n if first else 0
    return rows.where(F.size("embedding") == length) if length else rows.limit(0), length


def matrix(column: pa.Array | pa.ChunkedArray, length: int, kind=np.float64) -> np.ndarray:
    """The lists of a column as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, length)
