"""Scalar functions, encoding-free."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.functions import recode
from panelforge.functions import scalars as sc
from panelforge.operators.aggregates import rmse
from panelforge.operators.filters import holds
from panelforge.operators.joins import attach_groups
from panelforge.sources import Tables

_PERIOD = "(year(o_orderdate) * 100 + month(o_orderdate))"


@query("x1_year_offset", f"SELECT o_orderkey, {_PERIOD} // 100 - 1994 AS year_delta FROM orders")
def year_offset(t: Tables):
    period = sc.period_of("o_orderdate")
    return t.orders.select("o_orderkey", sc.year_offset(period, 1994).alias("year_delta"))


@query(
    "x2_period_month",
    f"SELECT o_orderkey, CAST(substr(CAST({_PERIOD} AS VARCHAR), 5, 2) AS INTEGER) AS month "
    "FROM orders",
)
def period_month(t: Tables):
    period = sc.period_of("o_orderdate")
    return t.orders.select("o_orderkey", sc.period_month(period).alias("month"))


@query(
    "x3_parse_period",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE "
    "strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') END AS first_day FROM orders",
)
def parse_period(t: Tables):
    period = sc.period_of("o_orderdate").cast("string")
    dirty = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(period)
    day = F.date_format(sc.parse_period(dirty), "yyyy-MM-dd")
    return t.orders.select("o_orderkey", day.alias("first_day"))


@query(
    "x4_parse_day",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE "
    "strftime(o_orderdate, '%Y-%m-%d') END AS day_dash, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END "
    "AS day_slash FROM orders",
)
def parse_day(t: Tables):
    key, ts = F.col("o_orderkey"), F.col("o_orderdate")
    dash = F.when(key % 10 == 0, F.lit("2001-13-45")).otherwise(F.date_format(ts, "yyyy-M-d"))
    slash = F.when(key % 11 == 0, F.lit("")).otherwise(F.date_format(ts, "yyyy/M/d"))
    return t.orders.select(
        "o_orderkey",
        F.date_format(sc.parse_day(dash, "-"), "yyyy-MM-dd").alias("day_dash"),
        F.date_format(sc.parse_day(slash, "/"), "yyyy-MM-dd").alias("day_slash"),
    )


@query("x5_month_of_date", "SELECT event_id, CAST(month(ts) AS INTEGER) AS month FROM events")
def month_of_date(t: Tables):
    return t.events.select("event_id", F.month("ts").alias("month"))


@query(
    "x6_day_difference",
    "SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', CAST(o_orderdate AS DATE), "
    "CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def day_difference(t: Tables):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = sc.days_between("l_shipdate", "o_orderdate").cast("bigint")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", days.alias("days"))


@query(
    "x7_digit_runs",
    "SELECT event_id, regexp_extract_all(event_type || props || event_id, '\\d+') AS runs "
    "FROM events",
)
def digit_runs(t: Tables):
    text = F.concat("event_type", "props", F.col("event_id").cast("string"))
    return t.events.select("event_id", sc.digit_runs(text).alias("runs"))


def price_band():
    """A band text per part: ``8-13W``, or ``3WL`` below size 5."""
    size = F.col("p_size")
    return F.when(size < 5, F.concat(size.cast("string"), F.lit("WL"))).otherwise(
        F.concat(size.cast("string"), F.lit("-"), (size + 5).cast("string"), F.lit("W"))
    )


@query(
    "x8_band_bounds",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS low, "
    "CAST(CASE WHEN p_size < 5 THEN p_size ELSE p_size + 5 END AS DOUBLE) AS high, "
    "CASE WHEN p_size < 5 THEN p_size ELSE p_size + 2.5 END::DOUBLE AS center FROM part",
)
def band_bounds(t: Tables):
    bounds = sc.band_bounds(price_band())
    return t.part.select("p_partkey", *[c.alias(n) for n, c in bounds.items()])


@query(
    "x9_piece_count",
    "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE "
    "len(regexp_split_to_array(text, '[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) END AS pieces "
    "FROM documents",
)
def piece_count(t: Tables):
    return t.documents.select("doc_id", sc.piece_count("text").cast("bigint").alias("pieces"))


@query(
    "x10_mentions",
    "SELECT p_partkey, CAST(contains(p_name, 'small') AS INTEGER) AS special, "
    "CAST(contains(p_name, 'ring') AND NOT contains(p_name, 'small') AS INTEGER) AS registration "
    "FROM part",
)
def mentions(t: Tables):
    return t.part.select(
        "p_partkey",
        sc.mentions("p_name", "small").cast("int").alias("special"),
        sc.mentions("p_name", "ring", without="small").cast("int").alias("registration"),
    )


@query(
    "x12_log_round_trip",
    "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS logged, "
    "round(o_totalprice, 4) AS restored FROM orders",
)
def log_round_trip(t: Tables):
    logged = t.orders.withColumn("_log", F.log1p("o_totalprice"))
    return logged.select(
        "o_orderkey",
        F.round("_log", 6).alias("logged"),
        F.round(F.expm1("_log"), 4).alias("restored"),
    )


@query(
    "x13_boxcox",
    "SELECT o_orderkey, round((pow(1 + o_totalprice, 0.15) - 1) / 0.15, 6) AS transformed, "
    "round(ln(1 + o_totalprice), 6) AS at_zero FROM orders",
)
def boxcox(t: Tables):
    return t.orders.select(
        "o_orderkey",
        F.round(sc.boxcox1p("o_totalprice", 0.15), 6).alias("transformed"),
        F.round(sc.boxcox1p("o_totalprice", 0.0), 6).alias("at_zero"),
    )


@query(
    "x14_infinity_test",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_tax = 0 AS INTEGER) AS infinite, "
    "CASE WHEN l_tax = 0 THEN 2.0 ELSE round(l_quantity / l_tax, 6) END AS replaced FROM lineitem",
)
def infinity_test(t: Tables):
    # a float divided by zero as pandas stores it
    raw = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(
        F.try_divide("l_quantity", "l_tax")
    )
    return t.lineitem.withColumn("_r", raw).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        sc.is_infinite("_r").cast("int").alias("infinite"),
        F.round(sc.replace_infinite("_r", 2.0), 6).alias("replaced"),
    )


@query(
    "x15_absolute_and_root",
    "SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)), 6) AS root "
    "FROM customer",
)
def absolute_and_root(t: Tables):
    size = F.abs("c_acctbal")
    return t.customer.select("c_custkey", size.alias("size"), F.round(F.sqrt(size), 6).alias("root"))


@query(
    "x16_tolerant_cast",
    "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS as_int, "
    "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS as_double, "
    "CAST(p_size AS VARCHAR) AS as_text FROM part",
)
def tolerant_cast(t: Tables):
    raw = F.when(F.col("p_size") % 7 == 0, F.lit("-")).otherwise(F.col("p_size").cast("string"))
    parts = t.part.withColumn("_raw", raw)
    return parts.select(
        "p_partkey",
        recode.replace_tokens("_raw", {}, "int").alias("as_int"),
        recode.replace_tokens("_raw", {}, "double").alias("as_double"),
        F.col("p_size").cast("string").alias("as_text"),
    )


@query(
    "x17_null_test",
    "SELECT d.doc_id, CAST(l.quality IS NULL AS INTEGER) AS missing FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def null_test(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, on="doc_id", how="left")
    return joined.select("doc_id", F.col("quality").isNull().cast("int").alias("missing"))


@query(
    "x18_boolean_logic",
    "SELECT d.doc_id, CAST(coalesce(quality = 1 AND NOT toxic = 1, false) AS INTEGER) AS good, "
    "CAST(NOT coalesce(quality = 1 OR toxic = 1, false) AS INTEGER) AS neither "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def boolean_logic(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, on="doc_id", how="left")
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return joined.select(
        "doc_id",
        holds(quality & ~toxic).cast("int").alias("good"),
        (~holds(quality | toxic)).cast("int").alias("neither"),
    )


@query(
    "a32_rmse",
    "SELECT o_orderpriority, round(sqrt(avg(pow(o_totalprice - m, 2))), 4) AS rmse FROM "
    "(SELECT *, avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) "
    "GROUP BY o_orderpriority",
)
def root_mean_squared_error(t: Tables):
    means = t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("m"))
    scored = attach_groups(t.orders, means, "o_orderstatus")
    result = rmse(scored, "o_totalprice", "m", keys=["o_orderpriority"])
    return result.withColumn("rmse", F.round("rmse", 4))
