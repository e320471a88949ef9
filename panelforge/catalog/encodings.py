"""Encodings, scaling, folds and splits."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelforge.catalog.aggregations import rounded
from panelforge.catalog.registry import query
from panelforge.catalog.views import HOUSES_SQL, SALES_SQL, houses, sales
from panelforge.operators import encode as en
from panelforge.operators import ranking as rk
from panelforge.operators.filters import union_tagged
from panelforge.operators.profile import skewed_columns
from panelforge.sources import Tables

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def _dummies(column: str, values) -> str:
    return ", ".join(
        f"CAST(coalesce({column} = '{v}', false) AS INTEGER) AS \"{column}_{v}\"" for v in values
    )


@query(
    "e1_one_hot_listed",
    f"SELECT p_partkey, p_brand, {_dummies('p_type', _TYPES)} FROM part",
)
def one_hot_listed(t: Tables):
    return en.one_hot(t.part.select("p_partkey", "p_brand", "p_type"), ["p_type"])


@query(
    "e2_one_hot_every_string",
    f"SELECT o_orderkey, {_dummies('o_orderstatus', ['F', 'O', 'P'])}, "
    + _dummies(
        "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    )
    + " FROM orders",
)
def one_hot_every_string(t: Tables):
    return en.one_hot(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query(
    "e3_shared_vocabulary",
    "WITH both_sides AS (SELECT c_custkey AS id, c_mktsegment AS segment, 'train' AS split "
    "FROM customer WHERE c_nationkey < 12 UNION ALL SELECT c_custkey, c_mktsegment, 'test' "
    f"FROM customer WHERE c_nationkey >= 12) SELECT id, split, {_dummies('segment', _SEGMENTS)} "
    "FROM both_sides",
)
def shared_vocabulary(t: Tables):
    people = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), "c_nationkey"
    )
    sides = union_tagged(
        {
            "train": people.filter("c_nationkey < 12").drop("c_nationkey"),
            "test": people.filter("c_nationkey >= 12").drop("c_nationkey"),
        }
    )
    return en.one_hot(sides, ["segment"])


@query(
    "e4_replace_categories",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sale_date, count(*) AS n, "
    + ", ".join(
        f"CAST(sum(CAST(l_returnflag = '{v}' AS INTEGER)) AS BIGINT) AS \"l_returnflag_{v}\""
        for v in "ANR"
    )
    + " FROM sales GROUP BY class_id, sale_date",
)
def replace_categories(t: Tables):
    coded = en.one_hot(sales(t).select("class_id", "sale_date", "l_returnflag"), ["l_returnflag"])
    marks = [c for c in coded.columns if c.startswith("l_returnflag_")]
    return coded.groupBy("class_id", "sale_date").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in marks]
    )


@query(
    "e5_one_hot_vocabulary_fit",
    "WITH s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code "
    "FROM customer GROUP BY c_mktsegment), n AS (SELECT count(*) AS n FROM s) "
    "SELECT c_custkey, c_mktsegment, CAST(code AS DOUBLE) AS code, list_transform(range(n), "
    "lambda i: CASE WHEN i = code THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS vector "
    "FROM customer JOIN s USING (c_mktsegment), n",
)
def one_hot_vocabulary_fit(t: Tables):
    index = StringIndexer(
        inputCol="c_mktsegment", outputCol="code", stringOrderType="alphabetAsc"
    )
    hot = OneHotEncoder(inputCols=["code"], outputCols=["vector"], dropLast=False)
    people = t.customer.select("c_custkey", "c_mktsegment")
    coded = Pipeline(stages=[index, hot]).fit(people).transform(people)
    return coded.withColumn("vector", vector_to_array("vector"))


@query(
    "e6_label_codes",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) "
    "AS o_orderpriority, CAST(dense_rank() OVER (ORDER BY month(o_orderdate)) - 1 AS INTEGER) "
    "AS month FROM orders",
)
def label_codes(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderpriority", F.month("o_orderdate").alias("month"))
    return en.label_codes(orders, ["o_orderpriority", "month"])


@query(
    "e6_label_codes_long",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (ORDER BY l_suppkey) - 1 "
    "AS INTEGER) AS l_suppkey FROM lineitem",
)
def label_codes_long(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return en.label_codes(lines, ["l_suppkey"])


@query(
    "e7_unskew",
    "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, "
    "round((pow(1 + tail, 0.15) - 1) / 0.15, 6) AS tail FROM "
    "(SELECT *, pow(o_totalprice / 10000.0, 4) AS tail FROM orders)",
)
def unskew(t: Tables):
    orders = t.orders.select(
        "o_orderkey",
        "o_totalprice",
        F.pow(F.col("o_totalprice") / F.lit(10000.0), F.lit(4.0)).alias("tail"),
    )
    assert skewed_columns(orders, ["o_totalprice", "tail"]) == ["tail"]
    out = en.unskew(orders, ["o_totalprice", "tail"])
    return rounded(rounded(out, 2, "o_totalprice"), 6, "tail")


@query(
    "e8_robust_scale",
    "WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS p, "
    "quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS n FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "round((l_extendedprice - p[2]) / (p[3] - p[1]), 6) AS l_extendedprice, "
    "round((l_quantity - n[2]) / (n[3] - n[1]), 6) AS l_quantity FROM lineitem, q",
)
def robust_scale(t: Tables):
    lines = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    scaled = en.robust_scale(lines, ["l_extendedprice", "l_quantity"])
    return rounded(scaled, 6, "l_extendedprice", "l_quantity")


@query(
    "e9_features_and_target",
    "WITH " + HOUSES_SQL + "SELECT frontage, area, condition, price FROM houses",
)
def features_and_target(t: Tables):
    h = houses(t)
    names, target = en.features_and_target(h, "price", "price", keys=["id", "neighborhood"])
    return h.select(*names, target)


# ---------------------------------------------------------------------------- folds, splits


@query(
    "m10_contiguous_folds",
    "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
)
def contiguous_folds(t: Tables):
    return rk.contiguous_folds(t.orders.select("o_orderkey"), [F.col("o_orderkey")], 5)


@query(
    "m16_shuffled_folds",
    "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY md5('156:' || c_custkey), c_custkey) - 1 "
    "AS INTEGER) AS fold FROM customer",
)
def shuffled_folds(t: Tables):
    return rk.shuffled_folds(t.customer.select("c_custkey"), ["c_custkey"], 7, seed=156)


@query(
    "m13_random_splits",
    "SELECT o_orderkey, "
    + ", ".join(
        f"CAST(('0x' || substr(md5('{i}:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.7 "
        f"AS INTEGER) AS split_{i}"
        for i in range(10)
    )
    + " FROM orders",
)
def random_splits(t: Tables):
    return rk.random_splits(t.orders.select("o_orderkey"), ["o_orderkey"], 0.7, 10)
