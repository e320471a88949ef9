"""Exact interpolated quantiles of raw columns, safe for groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here each wanted rank is found by radix selection:
doubles become 64-bit integers of the same order, and a pass counts the rows per (group, column, leading bits), with
partial sums in every task, so that no row is moved. The cell that holds a rank is looked into with ``DIGIT`` more bits in
the next pass, for all wanted ranks at once, until the rank is that of the cell's least or largest value; after the last of
five passes a cell is one value. Tables of any size take this one way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import pin

#: Bits that a pass adds: a group and column has at most ``2 ** DIGIT`` cells for each of its wanted ranks.
DIGIT = 13
_BITS = 64


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``k, s``: per column a long that orders like its double; both zeros are one value, nan is the largest.

    Spark has no expression for the bits of a double, hence the Arrow batches.
    """
    for batch in batches:
        rows, columns = batch.num_rows, batch.columns[1:]
        bits = np.empty((rows, len(columns)), np.int64)
        gaps = np.empty((rows, len(columns)), bool)
        for i, column in enumerate(columns):
            gaps[:, i] = column.is_null().to_numpy(zero_copy_only=False)
            x = column.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
            bits[:, i] = np.where(np.isnan(x), np.nan, x).view(np.int64)
        bits = np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)
        ends = pa.array(np.arange(rows + 1, dtype=np.int32) * len(columns))
        lists = pa.ListArray.from_arrays(ends, pa.array(bits.reshape(-1), mask=gaps.reshape(-1)))
        yield pa.record_batch([batch.column(0), lists], ["k", "s"])


def _double(ordered: Column) -> Column:
    bits = F.when(ordered < 0, ordered.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(ordered)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """One row per key; per column an array of its quantiles (null for an all-null group).

    Quantiles interpolate linearly between the two nearest values. Without keys the result is one row.
    """
    keys, columns, probabilities = list(keys), list(columns), [float(p) for p in probabilities]
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    values = df.select(group.alias("k"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    schema = T.StructType([values.schema["k"], T.StructField("s", T.ArrayType(T.LongType()))])
    values = values.mapInArrow(_ordered, schema)
    flat = values.select("k", F.posexplode("s").alias("c", "s"))  # nulls stay: they show that a group is there
    shift = _BITS - DIGIT
    cells = pin(_cells(flat, ["k", "c"], shift), "quantile-cells")
    groups = cells.select("k").distinct() if keys else df.sparkSession.range(1).select(F.struct(F.lit(0)).alias("k"))
    running = Window.partitionBy("k", "c").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    placed = cells.where("cell IS NOT NULL").withColumn("end", F.sum("n").over(running))
    placed = placed.withColumn("total", F.sum("n").over(Window.partitionBy("k", "c")))
    ranks = []
    for j, p in enumerate(probabilities):
        exact = (F.col("total") - 1) * F.lit(p)
        for side, rank in enumerate((F.floor(exact), F.ceil(exact))):
            fields = {"j": F.lit(j), "side": F.lit(side), "rank": rank.cast("long"), "part": exact - F.floor(exact)}
            ranks.append(F.struct(*[v.alias(n) for n, v in fields.items()]))
    wanted = placed.select("*", F.explode(F.array(*ranks)).alias("r")).select("k", "c", "cell", "lo", "hi", "n", "end", "r.*")
    wanted = wanted.where("end - n <= rank AND rank < end").withColumn("rest", F.col("rank") - (F.col("end") - F.col("n")))
    found = [pin(_ranks(wanted), "quantile-ranks")]
    while True:
        open_ = found[-1].where("v IS NULL")
        asked = open_.collect() if not keys else open_.head(1)  # without keys a few rows for each column
        if not asked:
            break
        before, shift = shift, max(0, shift - DIGIT)
        if keys:
            here = open_.groupBy("k", "c").agg(F.collect_set("cell").alias("asked"))
            inside = flat.join(here, ["k", "c"])
        else:
            here = [F.array(*[F.lit(r.cell) for r in asked if r.c == i]).cast("array<long>") for i in range(len(columns))]
            inside = flat.withColumn("asked", F.get(F.array(*here), F.col("c")))
        inside = inside.withColumn("parent", F.shiftright("s", before)).where(F.array_contains("asked", F.col("parent")))
        running = Window.partitionBy("k", "c", "parent").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        placed = _cells(inside, ["k", "c", "parent"], shift).withColumn("end", F.sum("n").over(running))
        still = open_.select("k", "c", "j", "side", "part", "rest", F.col("cell").alias("parent"))
        wanted = still.join(placed, ["k", "c", "parent"]).where("end - n <= rest AND rest < end")
        wanted = wanted.withColumn("rest", F.col("rest") - (F.col("end") - F.col("n")))
        found.append(pin(_ranks(wanted), "quantile-ranks"))
    known = found[0].where("v IS NOT NULL")
    for more in found[1:]:
        known = known.unionByName(more.where("v IS NOT NULL"))
    known = known.withColumn("v", _double(F.col("v")))
    quantiles = []
    for i in range(len(columns)):
        at = []
        for j in range(len(probabilities)):
            here = (F.col("c") == i) & (F.col("j") == j)
            low, high = (F.max(F.when(here & (F.col("side") == side), F.col("v"))) for side in (0, 1))
            part = F.max(F.when(here, F.col("part")))
            at.append(F.when((part == 0) | (low == high), low).otherwise(low + (high - low) * part))
        quantiles.append(F.array(*at).alias(f"q{i}"))
    solved = known.groupBy("k").agg(*quantiles)
    out = groups.join(known.groupBy("k").agg(*quantiles), "k", "left")
    nothing = F.array(*[F.lit(None).cast("double") for _ in probabilities])
    answers = [F.coalesce(f"q{i}", nothing).alias(c) for i, c in enumerate(columns)]
    return out.select(*[F.col("k").getField(name).alias(name) for name in keys], *answers)


def _cells(rows: DataFrame, by: list[str], shift: int) -> DataFrame:
    """Rows, least and largest value of each cell: of the values that agree in all but the last ``shift`` bits."""
    cell = F.shiftright("s", shift).alias("cell")
    return rows.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))


def _ranks(wanted: DataFrame) -> DataFrame:
    """Wanted ranks with their value ``v``, null where it is neither the least nor the largest of its cell."""
    v = F.when((F.col("rest") == 0) | (F.col("lo") == F.col("hi")), F.col("lo")).when(F.col("rest") == F.col("n") - 1, F.col("hi"))
    return wanted.select("k", "c", "j", "side", "part", "rest", "cell", v.alias("v"))


def exact_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with the median of each column."""
    q = exact_quantiles(df, keys, columns, [0.5])
    return q.select(*keys, *[F.col(c)[0].alias(c) for c in columns])
