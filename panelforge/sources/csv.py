"""CSV scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
# The texts that the usual table readers take for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# from narrow to wide; a column gets the first type that all its values have
_TYPES = ("int", "bigint", "double", "timestamp")


def _as_schema(schema: T.StructType | str | None) -> T.StructType | None:
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    return schema


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    header: bool = True,
    null_tokens: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Scan CSV files.

    Give a schema for large inputs: without one the files are read twice to infer types. A
    byte-order mark before the first header name is removed. ``null_tokens`` (``NULL_TOKENS``)
    are read as null; types are inferred from the other values.
    """
    if null_tokens is not None:
        return _read_with_nulls(spark, path, schema, header, null_tokens, options)
    reader = spark.read.option("header", header)
    for name, value in options.items():
        reader = reader.option(name, value)
    schema = _as_schema(schema)
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", True).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip(BOM)) if first.startswith(BOM) else df


def _read_with_nulls(spark, path, schema, header, tokens, options) -> DataFrame:
    """Every field as text, its null tokens as null, then cast."""
    schema = _as_schema(schema)
    text = schema and T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    reader = spark.read.option("header", header)
    for name, value in options.items():
        reader = reader.option(name, value)
    raw = (reader.schema(text) if text else reader).csv(path)
    if not text:
        raw = raw.toDF(*(c.lstrip(BOM) for c in raw.columns))
    raw = raw.select(
        *[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    )
    if schema:
        return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])
    misfits = raw.agg(
        *[
            F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull()).alias(f"{i}_{t}")
            for i, c in enumerate(raw.columns)
            for t in _TYPES
        ]
    ).first()
    kinds = [next((t for t in _TYPES if not misfits[f"{i}_{t}"]), "string") for i in range(len(raw.columns))]
    return raw.select(
        *[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in zip(raw.columns, kinds, strict=True)]
    )


def read_csv_named(
    spark: SparkSession,
    path: str | list[str],
    names: Sequence[str],
    types: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Scan headerless CSV files and name the columns; the first may serve as the key."""
    if types is not None:
        schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))
        return read_csv(spark, path, schema, header=False, **options)
    return read_csv(spark, path, header=False, **options).toDF(*names)


def read_csv_stray_header(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str
) -> DataFrame:
    """Scan CSV files whose header line may stand anywhere, even last.

    Every field is read as text; the lines that repeat the column names are dropped and the
    rest is cast (a value that does not fit its type becomes null).
    """
    schema = _as_schema(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = read_csv(spark, path, text, header=False)
    is_header = F.lit(True)
    for f in schema:
        is_header = is_header & F.col(f"`{f.name}`").eqNullSafe(F.lit(f.name))
    return raw.filter(~is_header).select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema]
    )


def write_csv(
    df: DataFrame, path: str, key: str | Sequence[str] | None = None, mode: str = "overwrite"
) -> None:
    """Write CSV with a header, one file per partition; ``key`` columns come first."""
    if key is not None:
        keys = [key] if isinstance(key, str) else list(key)
        df = df.select(*keys, *[c for c in df.columns if c not in keys])
    df.write.mode(mode).option("header", True).csv(path)
