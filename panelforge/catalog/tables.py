"""Scans, sinks and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.operators import profile as pr
from panelforge.session import scratch_path
from panelforge.sources import (
    NULL_TOKENS,
    Tables,
    read_csv,
    read_csv_named,
    read_csv_stray_header,
    write_csv,
)

PART_DDL = (
    "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double"
)


@query("s1_csv_scan_inferred", "SELECT * FROM part")
def csv_scan_inferred(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.part, path)
    df = read_csv(t.spark, path)
    return df.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("s2_csv_scan_typed", "SELECT * FROM part")
def csv_scan_typed(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.part, path)
    return read_csv(t.spark, path, PART_DDL, header=True)


@query(
    "s1_csv_null_tokens",
    "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size END AS p_size, "
    "CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS p_retailprice, "
    "CASE WHEN p_size % 3 <> 0 THEN p_type END AS p_type FROM part",
)
def csv_null_tokens(t: Tables):
    path = scratch_path(t.spark, "csv")
    marked = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("string")).otherwise("NA").alias("p_size"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice").cast("string"))
        .otherwise("N/A")
        .alias("p_retailprice"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise("NA").alias("p_type"),
    )
    write_csv(marked, path)
    df = read_csv(t.spark, path, null_tokens=NULL_TOKENS)
    return df.withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query("s3_csv_scan_headerless", "SELECT doc_id AS person, quality AS label FROM labels")
def csv_scan_headerless(t: Tables):
    path = scratch_path(t.spark, "csv")
    t.labels.select("doc_id", "quality").write.csv(path)
    return read_csv_named(t.spark, path, ["person", "label"], ["bigint", "int"])


@query(
    "s4_csv_scan_keyed",
    "SELECT c_custkey AS person, CAST(c_acctbal < 0 AS INTEGER) AS label FROM customer",
)
def csv_scan_keyed(t: Tables):
    path = scratch_path(t.spark, "csv")
    flagged = t.customer.select("c_custkey", (F.col("c_acctbal") < 0).cast("int"))
    flagged.write.csv(path)
    return read_csv_named(t.spark, path, ["person", "label"], ["bigint", "int"])


@query(
    "s5_csv_sink",
    "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders",
)
def csv_sink(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.orders, path)
    ddl = (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    )
    df = read_csv(t.spark, path, ddl)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "s6_csv_sink_keyed",
    "SELECT s_suppkey, s_name, s_acctbal, 's_suppkey' AS first_column FROM supplier",
)
def csv_sink_keyed(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.supplier.select("s_name", "s_acctbal", "s_suppkey"), path, key="s_suppkey")
    first = t.spark.read.option("header", True).csv(path).columns[0]
    df = read_csv(t.spark, path, "s_suppkey bigint, s_name string, s_acctbal double")
    return df.withColumn("first_column", F.lit(first))


@query("s5_csv_stray_header", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_stray_header(t: Tables):
    path = scratch_path(t.spark, "csv")
    write_csv(t.nation, path)
    return read_csv_stray_header(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


_PROFILED = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]


@query(
    "s7_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{ty}' AS type, count(*) AS rows, "
        f"count(CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> 'A' THEN 1 END) AS non_null "
        "FROM lineitem"
        for c, ty in _PROFILED
    ),
)
def profile(t: Tables):
    return pr.profile(t.lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("A"))))


@query(
    "s8_preview",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def preview(t: Tables):
    columns = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return pr.preview(columns, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)
