"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import pin

#: Row numbers whose bits share one bitmap: Spark's bitmaps have 4096 bytes.
MARKS_LOG = 15
#: Words are runs of anything but space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, found by exact name even if others differ only in case."""
    places = [df.columns.index(name) for name in names]
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)))


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` with a number ``row`` for each of its rows, written so that the numbers stay; its columns are ``c0, c1, ...``."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return pin(plain.withColumn("row", F.monotonically_increasing_id()), label)


def marked(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The ``rows`` whose ``row`` is in ``numbers``, where both have the numbers of a ``numbered`` frame.

    Only numbers are shuffled, into a bitmap for each run of consecutive ones. The bitmaps are written, so that their
    measured size decides the join: they take a bit for each number, so ``rows`` stay where they are unless there are very many.
    """
    place = F.col("row").bitwiseAND((1 << MARKS_LOG) - 1)
    bits = numbers.select(F.shiftright("row", MARKS_LOG).alias("marks_of"), place.alias("place")).repartition("marks_of")
    marks = pin(bits.groupBy("marks_of").agg(F.bitmap_construct_agg("place").alias("marks")), "marks")
    byte = F.conv(F.hex(F.substring(F.col("marks"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1
    return rows.join(marks, (F.shiftright("row", MARKS_LOG) == F.col("marks_of")) & is_set, "left_semi")


def rows_of(kept: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a ``numbered`` frame whose ``row`` is in ``numbers``."""
    return marked(kept, numbers).drop("row").toDF(*columns)


def power_of_two(n: float) -> int:
    """The smallest power of two that is at least ``n``."""
    out = 1
    while out < n:
        out *= 2
    return out


def release() -> None:
    """Gives freed memory back to the system: Python workers wait idle between tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def releasing(fn: Callable) -> Callable:
    """``fn`` of one or two tables, for ``applyInArrow``, with ``release`` after it."""

    def run(table):
        out = fn(table)
        release()
        return out

    def run_with_key(key, table):
        out = fn(key, table)
        release()
        return out

    return run if fn.__code__.co_argcount == 1 else run_with_key


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)
            del batch
            release()

    return df.mapInArrow(run, schema)


def text_parts(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """``(first, end, texts)`` of consecutive rows with ``limit`` bytes, or one row, at a time.

    Null texts come as empty ones; only the texts of one part are held as Python strings.
    """
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        end = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield first, end, [t or "" for t in column.slice(first, end - first).to_pylist()]
        first = end


def chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """``(first, end)`` of consecutive texts, ``limit`` characters or one text at a time."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text)
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(texts):
        yield first, len(texts)
