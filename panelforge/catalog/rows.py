"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.catalog.views import SALES_SQL, sales
from panelforge.functions.ratios import null_as_zero_sum
from panelforge.operators import columns as cols
from panelforge.operators import filters as flt
from panelforge.operators.aggregates import mean_by
from panelforge.operators.profile import missing_share, skew_table
from panelforge.sources import Tables

# --------------------------------------------------------------------------- projections


@query(
    "p1_drop_columns",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_returnflag, l_linestatus FROM lineitem",
)
def drop_columns(t: Tables):
    return t.lineitem.drop("l_discount", "l_tax", "l_shipdate")


@query(
    "p2_drop_column_range",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, "
    "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem",
)
def drop_column_range(t: Tables):
    left = cols.drop_ranges(t.lineitem, [("l_quantity", "l_tax")])
    return left.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


@query(
    "p3_rename",
    "SELECT s_suppkey AS hospital, s_name AS hospital_name, s_nationkey, s_acctbal FROM supplier",
)
def rename(t: Tables):
    return cols.rename(t.supplier, {"s_suppkey": "hospital", "s_name": "hospital_name"})


@query(
    "p4_prefix_suffix_names",
    "SELECT c_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS sum_c_acctbal_total "
    "FROM customer GROUP BY c_nationkey",
)
def prefix_suffix_names(t: Tables):
    sums = t.customer.groupBy("c_nationkey").agg(
        F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("c_acctbal")
    )
    named = cols.add_prefix(sums, "sum", keep=["c_nationkey"])
    return cols.add_suffix(named, "total", keep=["c_nationkey"])


@query("p5_select_columns", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def select_columns(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "p6_drop_matching_columns",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sum(sale_quantity) AS sum_total, avg(p_size) AS mean_p_size "
    "FROM sales GROUP BY class_id",
)
def drop_matching_columns(t: Tables):
    wide = sales(t).groupBy("class_id").agg(
        F.sum("sale_quantity").alias("sum_total"),
        F.avg("sale_quantity").alias("mean_sale_quantity"),
        F.stddev_samp("sale_quantity").alias("std_sale_quantity"),
        F.avg("p_size").alias("mean_p_size"),
    )
    return cols.drop_matching(wide, "sale_quantity")


_ZERO_TEST = ("l_orderkey", "l_discount", "l_tax", "never")


@query(
    "p7_nonzero_flags",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", max(CASE WHEN coalesce({c}, 0) <> 0 THEN 1 ELSE 0 END) "
        "AS nonzero FROM (SELECT *, nullif(l_linenumber, l_linenumber) AS never FROM lineitem)"
        for c in _ZERO_TEST
    ),
)
def nonzero_flags(t: Tables):
    lines = t.lineitem.withColumn("never", F.nullif("l_linenumber", F.col("l_linenumber")))
    return cols.nonzero_flags(lines.select(*_ZERO_TEST))


@query(
    "p8_common_nonzero_columns",
    "SELECT l_orderkey, l_quantity, l_tax FROM lineitem WHERE l_returnflag = 'A'",
)
def common_nonzero_columns(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    train = lines.filter("l_returnflag = 'A'").drop("l_returnflag")
    test = lines.filter("l_returnflag <> 'A'").drop("l_returnflag")
    test = test.withColumn("l_discount", F.lit(0.0))
    return train.select(*cols.common_nonzero(train, test))


@query(
    "p9_numeric_complete_columns",
    "SELECT c_custkey, c_nationkey, c_acctbal FROM customer",
)
def numeric_complete_columns(t: Tables):
    gap = F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))
    return cols.numeric_complete(t.customer.withColumn("gap", gap))


@query(
    "p10_product_column",
    "SELECT p_partkey, round(p_size * p_retailprice * p_size / 1000000.0, 8) AS volume FROM part",
)
def product_column(t: Tables):
    volume = cols.product("p_size", "p_retailprice", "p_size", scale=1e6)
    return t.part.select("p_partkey", F.round(volume, 8).alias("volume"))


@query(
    "p11_sum_columns",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount "
    "+ nullif(l_tax, 0), 4) AS total FROM lineitem",
)
def sum_columns(t: Tables):
    lines = t.lineitem.withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    total = cols.total("l_quantity", "l_discount", "l_tax")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(total, 4).alias("total"))


@query(
    "p12_sum_skipping_nulls",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity + l_discount "
    "+ coalesce(nullif(l_tax, 0.01), 0), 4) AS total FROM lineitem",
)
def sum_skipping_nulls(t: Tables):
    lines = t.lineitem.withColumn("l_tax", F.nullif("l_tax", F.lit(0.01)))
    total = null_as_zero_sum("l_quantity", "l_discount", "l_tax")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", F.round(total, 4).alias("total"))


@query(
    "p13_line_amount",
    "SELECT l_orderkey, l_linenumber, l_partkey, "
    "round((l_extendedprice / l_quantity) * l_quantity, 2) AS amount FROM lineitem",
)
def line_amount(t: Tables):
    lines = t.lineitem.withColumn("unit_price", F.col("l_extendedprice") / F.col("l_quantity"))
    amount = cols.product("unit_price", "l_quantity")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(amount, 2).alias("amount")
    )


@query(
    "p14_append_derived_columns",
    "SELECT o_orderkey, 'train' AS split, CAST(o_orderstatus = 'F' AS INTEGER) AS label "
    "FROM orders",
)
def append_derived_columns(t: Tables):
    label = (F.col("o_orderstatus") == "F").cast("int")
    derived = t.orders.withColumns({"split": F.lit("train"), "label": label})
    return derived.select("o_orderkey", "split", "label")


# ------------------------------------------------------------------------------- filters


@query(
    "f1_keep_months",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sale_date, count(*) AS n, sum(sale_quantity) AS quantity FROM sales "
    "WHERE sale_date % 100 IN (9, 10, 11) GROUP BY class_id, sale_date",
)
def keep_months(t: Tables):
    kept = flt.keep_months(sales(t), "sale_date", (9, 10, 11))
    return kept.groupBy("class_id", "sale_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sale_quantity").alias("quantity")
    )


@query(
    "f2_drop_where_any",
    "SELECT p_partkey, p_brand, p_size FROM part WHERE NOT (coalesce(nullif(p_size, 7) IN (2, 3), "
    "false) OR p_type IN ('PROMO', 'SMALL') OR p_brand IN ('Brand#1', 'Brand#25'))",
)
def drop_where_any(t: Tables):
    parts = t.part.withColumn("size", F.nullif("p_size", F.lit(7)))
    kept = flt.drop_where_any(
        parts,
        {"size": [2, 3], "p_type": ["PROMO", "SMALL"], "p_brand": ["Brand#1", "Brand#25"]},
    )
    return kept.select("p_partkey", "p_brand", "p_size")


@query(
    "f3_period_threshold",
    "SELECT count(*) AS n, sum(l_quantity) AS quantity, "
    "year(l_shipdate) * 100 + month(l_shipdate) AS period FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY period",
)
def period_threshold(t: Tables):
    recent = flt.after(t.lineitem, "l_shipdate", "1998-12-31 23:59:59.999999")
    period = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("period")
    return recent.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "f4_drop_outliers",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice > 400000 "
    "AND o_custkey < 300)",
)
def drop_outliers(t: Tables):
    outlier = (F.col("o_totalprice") > 400000) & (F.col("o_custkey") < 300)
    return flt.drop_where(t.orders, outlier).select("o_orderkey", "o_totalprice")


@query(
    "f5_split_by_period",
    "WITH "
    + SALES_SQL
    + "SELECT CASE WHEN sale_date = 200110 THEN 'predict' ELSE 'train' END AS side, "
    "count(*) AS n, sum(sale_quantity) AS quantity FROM sales GROUP BY side",
)
def split_by_period(t: Tables):
    predict, train = flt.split_where(sales(t), F.col("sale_date") == 200110)
    sides = [("predict", predict), ("train", train)]
    parts = [
        side.agg(F.count(F.lit(1)).alias("n"), F.sum("sale_quantity").alias("quantity")).withColumn(
            "side", F.lit(name)
        )
        for name, side in sides
    ]
    return parts[0].unionByName(parts[1])


@query(
    "f6_split_by_origin",
    "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, 'train' AS side "
    "FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, 'test' FROM supplier",
)
def split_by_origin(t: Tables):
    train = t.customer.select(
        F.col("c_custkey").alias("key"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    test = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    both = flt.union_tagged({"train": train, "test": test})
    sides = [flt.take_tagged(both, s).withColumn("side", F.lit(s)) for s in ("train", "test")]
    return sides[0].unionByName(sides[1])


@query(
    "f7_drop_incomplete",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem "
    "WHERE l_discount <> 0 AND l_tax <> 0",
)
def drop_incomplete(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    gaps = {c: F.nullif(c, F.lit(0.0)) for c in ("l_discount", "l_tax")}
    return flt.drop_incomplete(lines.withColumns(gaps), ["l_discount", "l_tax"])


@query("f8_label_equals", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def label_equals(t: Tables):
    return t.labels.filter(F.col("quality") == 1)


_SKEWED = ("l_quantity", "l_extendedprice", "l_discount", "tail")


def _moments(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", (avg({c}*{c}*{c}) - 3*avg({c})*avg({c}*{c}) "
        f"+ 2*pow(avg({c}), 3)) / pow(var_pop({c}), 1.5) AS skew FROM "
        "(SELECT *, CAST(pow(l_linenumber, 6) AS DOUBLE) AS tail FROM lineitem)"
    )


@query(
    "f9_beyond_threshold",
    "SELECT \"column\", round(skew, 4) AS skew FROM ("
    + " UNION ALL ".join(_moments(c) for c in _SKEWED)
    + ") WHERE abs(skew) > 0.75",
)
def beyond_threshold(t: Tables):
    lines = t.lineitem.withColumn("tail", F.pow("l_linenumber", F.lit(6.0)))
    skews = flt.beyond(skew_table(lines, _SKEWED), "skew", 0.75)
    return skews.withColumn("skew", F.round("skew", 4))


@query(
    "f10_drop_zero_entries",
    "SELECT \"column\", round(missing_pct, 6) AS missing_pct FROM ("
    "SELECT 'l_discount' AS \"column\", 100.0 * count(CASE WHEN l_discount = 0 THEN 1 END) "
    "/ count(*) AS missing_pct FROM lineitem UNION ALL SELECT 'l_tax', "
    "100.0 * count(CASE WHEN l_tax = 0 THEN 1 END) / count(*) FROM lineitem)",
)
def drop_zero_entries(t: Tables):
    lines = t.lineitem.select("l_orderkey", "l_discount", "l_tax")
    gaps = {c: F.nullif(c, F.lit(0.0)) for c in ("l_discount", "l_tax")}
    shares = flt.drop_zero(missing_share(lines.withColumns(gaps)), "missing_pct")
    return shares.withColumn("missing_pct", F.round("missing_pct", 6))


@query(
    "a10_mean_by_class_and_date",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sale_date, round(avg(sale_quantity), 6) AS mean_sale_quantity FROM sales "
    "GROUP BY class_id, sale_date",
)
def mean_by_class_and_date(t: Tables):
    means = mean_by(sales(t), ["class_id", "sale_date"], ["sale_quantity"])
    return means.withColumn("mean_sale_quantity", F.round("mean_sale_quantity", 6))
