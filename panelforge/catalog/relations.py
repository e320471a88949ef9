"""Joins, set operations, sorts and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.catalog.views import (
    BASE_YEAR,
    FEE_SQL,
    SALES_SQL,
    VISITS_SQL,
    fee_lines,
    part_classes,
    sales,
    visits,
)
from panelforge.functions.scalars import period_of
from panelforge.operators import entity as ent
from panelforge.operators import joins
from panelforge.operators import profile as pr
from panelforge.operators import ranking as rk
from panelforge.operators.aggregates import totals, value_counts
from panelforge.operators.filters import split_where
from panelforge.session import pin
from panelforge.sources import Tables

# ----------------------------------------------------------------------------------- joins


@query(
    "j1_inner_join",
    "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM orders "
    "JOIN customer ON o_custkey = c_custkey",
)
def inner_join(t: Tables):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    joined = joins.inner(orders, t.customer, "c_custkey")
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(
    "j2_natural_join",
    "SELECT d.doc_id, source, lang, quality, toxic FROM documents d "
    "JOIN labels l ON d.doc_id = l.doc_id",
)
def natural_join(t: Tables):
    return joins.natural(t.documents.select("doc_id", "source", "lang"), t.labels)


@query(
    "j3_suffixed_join",
    "SELECT c_nationkey AS nation, c.n AS n_x, s.n AS n_y, c.balance AS balance_x, "
    "s.balance AS balance_y FROM "
    "(SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer "
    "GROUP BY 1) c JOIN (SELECT s_nationkey, count(*) AS n, round(avg(s_acctbal), 4) AS balance "
    "FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey",
)
def suffixed_join(t: Tables):
    def by_nation(df, p):
        return df.groupBy(F.col(f"{p}_nationkey").alias("nation")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg(f"{p}_acctbal"), 4).alias("balance")
        )

    return joins.suffixed(by_nation(t.customer, "c"), by_nation(t.supplier, "s"), "nation")


@query(
    "j4_feature_blocks_inner",
    "WITH "
    + FEE_SQL
    + "SELECT person, count(DISTINCT venue) AS venues, count(*) AS records, "
    "count(DISTINCT day) AS days FROM fee GROUP BY person",
)
def feature_blocks_inner(t: Tables):
    fee = fee_lines(t)
    venues = fee.groupBy("person", "venue").agg(F.count(F.lit(1)).alias("n"))
    days = ent.distinct_days(fee, "person", "day")
    blocks = [
        venues.groupBy("person").agg(
            F.count(F.lit(1)).alias("venues"), F.sum("n").alias("records")
        ),
        days.groupBy("person").agg(F.count(F.lit(1)).alias("days")),
    ]
    return joins.align(blocks, "person")


@query(
    "j5_feature_blocks_outer",
    "SELECT coalesce(o_custkey, person) AS person, n_orders, n_urgent FROM "
    "(SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) "
    "FULL JOIN (SELECT o_custkey AS person, count(*) AS n_urgent FROM orders "
    "WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = person",
)
def feature_blocks_outer(t: Tables):
    person = F.col("o_custkey").alias("person")
    finished = t.orders.filter("o_orderstatus = 'F'").groupBy(person)
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").groupBy(person)
    blocks = [
        ent_count.agg(F.count(F.lit(1)).alias(name))
        for ent_count, name in ((finished, "n_orders"), (urgent, "n_urgent"))
    ]
    return joins.align(blocks, "person", how="full")


@query(
    "j6_same_grouping_one_pass",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, round(avg(p_size), 6) AS mean_size, sum(sale_quantity) AS sum_quantity, "
    "round(stddev_samp(sale_quantity), 6) AS std_quantity FROM sales GROUP BY class_id",
)
def same_grouping_one_pass(t: Tables):
    return sales(t).groupBy("class_id").agg(
        F.round(F.avg("p_size"), 6).alias("mean_size"),
        F.sum("sale_quantity").alias("sum_quantity"),
        F.round(F.stddev_samp("sale_quantity"), 6).alias("std_quantity"),
    )


@query(
    "j7_foreign_key_enrichment",
    "SELECT l_orderkey AS visit, o_custkey AS person, l_linenumber, l_partkey, l_quantity "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def foreign_key_enrichment(t: Tables):
    keys = t.orders.withColumnsRenamed({"o_orderkey": "visit", "o_custkey": "person"})
    train, test = split_where(keys, F.col("o_orderdate") < "2000-01-01")
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("visit"), "l_linenumber", "l_partkey", "l_quantity"
    )
    return joins.enrich(lines, [train, test], "visit", ["person"])


@query(
    "j8_label_join",
    "SELECT d.doc_id, source, n_chars, quality AS label FROM documents d "
    "JOIN labels l ON d.doc_id = l.doc_id",
)
def label_join(t: Tables):
    labels = t.labels.select("doc_id", F.col("quality").alias("label"))
    return joins.inner(t.documents.select("doc_id", "source", "n_chars"), labels, "doc_id")


@query(
    "j9_period_dimension",
    "WITH "
    + SALES_SQL
    + "SELECT year_delta, month, count(*) AS n, sum(sale_quantity) AS quantity FROM "
    "(SELECT *, sale_date // 100 - 1994 AS year_delta, sale_date % 100 AS month FROM sales) "
    "GROUP BY year_delta, month",
)
def period_dimension(t: Tables):
    lines = t.lineitem.select(
        period_of("l_shipdate").alias("sale_date"), F.col("l_quantity").alias("q")
    )
    # quantities are summed per period before the dimension is joined
    by_period = lines.groupBy("sale_date").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    joined = joins.natural(by_period, joins.period_dimension(by_period, "sale_date", BASE_YEAR))
    return joined.groupBy("year_delta", "month").agg(
        F.sum("n").alias("n"), F.sum("q").alias("quantity")
    )


@query(
    "j10_membership",
    "SELECT o_orderkey, o_custkey, CAST(o_custkey IN (SELECT c_custkey FROM customer "
    "WHERE c_acctbal < 0) AS INTEGER) AS flagged FROM orders",
)
def membership(t: Tables):
    debtors = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = t.orders.select("o_orderkey", "o_custkey")
    return joins.member_flag(orders, debtors, "o_custkey", "flagged")


@query(
    "j10_members_only",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN "
    "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def members_only(t: Tables):
    debtors = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.members(t.orders.select("o_orderkey", "o_custkey"), debtors, "o_custkey")


@query(
    "j11_lookup_default",
    "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) "
    "ON c_custkey = o_custkey",
)
def lookup_default(t: Tables):
    large = t.orders.filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    counts = value_counts(large, "c_custkey", "n_orders")
    return joins.lookup(t.customer.select("c_custkey"), counts, "c_custkey", "n_orders", 0)


@query(
    "j12_attach_by_key",
    "SELECT c_custkey, n AS n_orders, CAST(n AS DOUBLE) AS as_double FROM customer LEFT JOIN "
    "(SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_totalprice > 400000 "
    "GROUP BY 1) ON c_custkey = o_custkey",
)
def attach_by_key(t: Tables):
    large = t.orders.filter("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    counts = value_counts(large, "c_custkey", "n_orders").withColumn(
        "n_orders", F.col("n_orders").cast("double")
    )
    attached = joins.attach(t.customer.select("c_custkey"), counts, "c_custkey")
    return attached.withColumn("as_double", F.col("n_orders"))


# --------------------------------------------------------------------------- set operations


@query(
    "u1_union_by_name",
    "SELECT s_suppkey AS id, s_acctbal AS balance, s_nationkey::DOUBLE AS nation, NULL AS segment "
    "FROM supplier UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer",
)
def union_by_name(t: Tables):
    suppliers = t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").cast("double").alias("nation"),
    )
    customers = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return joins.union_all([suppliers, customers])


@query(
    "u2_union_keys",
    "SELECT o_orderkey AS visit, o_custkey AS person FROM orders UNION ALL "
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'",
)
def union_keys(t: Tables):
    keys = t.orders.withColumnsRenamed({"o_orderkey": "visit", "o_custkey": "person"})
    return joins.union_keys([keys, keys.filter("o_orderstatus = 'F'")], ["visit", "person"])


@query(
    "u3_distinct_values",
    "SELECT DISTINCT year(l_shipdate) * 100 + month(l_shipdate) AS period FROM lineitem",
)
def distinct_values(t: Tables):
    return t.lineitem.select(period_of("l_shipdate").cast("bigint").alias("period")).distinct()


@query(
    "u4_complement",
    "SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, "
    "false)",
)
def complement(t: Tables):
    nation = F.nullif(F.col("c_nationkey"), F.lit(3))
    return split_where(t.customer, nation > 10)[1].select("c_custkey", "c_acctbal")


@query(
    "u5_common_column_names",
    "SELECT id, balance FROM (SELECT c_custkey AS id, c_acctbal AS balance FROM customer) "
    "UNION ALL SELECT s_suppkey, s_acctbal FROM supplier",
)
def common_column_names(t: Tables):
    a = t.customer.withColumnsRenamed({"c_custkey": "id", "c_acctbal": "balance"})
    b = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_acctbal": "balance"})
    shared = [c for c in a.columns if c in b.columns]
    return joins.union_keys([a, b], shared)


# --------------------------------------------------------------------------- sort and limit


@query(
    "o1_sort",
    "SELECT p_brand, round(sum(p_retailprice), 2) AS total FROM part GROUP BY p_brand "
    "ORDER BY total DESC",
)
def sort(t: Tables):
    sums = t.part.groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("total"))
    return sums.orderBy(F.col("total").desc())


@query(
    "o2_top_k",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey "
    "LIMIT 30",
)
def top_k(t: Tables):
    return pr.top(value_counts(t.orders, "o_custkey"), "n", 30, ["o_custkey"])


@query(
    "o3_first_n",
    "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 10",
)
def first_n(t: Tables):
    return pr.preview(t.supplier.select("s_suppkey", "s_name"), ["s_suppkey"], 10)


@query(
    "o4_sorted_distinct_values",
    "SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate) * 100 + month(o_orderdate))) "
    "AS periods FROM orders GROUP BY o_custkey",
)
def sorted_distinct_values(t: Tables):
    # months are bounded by the calendar, so the collected sets stay small for any customer
    periods = F.array_sort(F.collect_set(period_of("o_orderdate").cast("bigint")))
    return t.orders.groupBy("o_custkey").agg(periods.alias("periods"))


# ------------------------------------------------------------------------------- positions


@query(
    "w1_rank_classes",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, total, row_number() OVER (ORDER BY total, class_id DESC) AS class_trans "
    "FROM (SELECT class_id, sum(sale_quantity) AS total FROM sales GROUP BY class_id)",
)
def rank_classes(t: Tables):
    by_part = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    classed = by_part.join(part_classes(t), F.col("l_partkey") == F.col("p_partkey"))
    return rk.rank_entities(totals(classed, ["class_id"], "q", "total"), "total", "class_id", "class_trans")


@query(
    "w2_group_transform",
    "SELECT c_custkey, c_acctbal, round(avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) "
    "AS nation_mean FROM customer",
)
def group_transform(t: Tables):
    means = t.customer.groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("nation_mean"))
    joined = joins.attach_groups(t.customer, means, "c_nationkey")
    return joined.select("c_custkey", "c_acctbal", "nation_mean")


@query(
    "w3_days_since_first",
    "SELECT o_custkey, strftime(day, '%Y-%m-%d') AS day, n, date_diff('day', "
    "min(day) OVER (PARTITION BY o_custkey), day) AS days FROM (SELECT o_custkey, "
    "CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2)",
)
def days_since_first(t: Tables):
    cells = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    counted = ent.days_since_first(cells, "o_custkey", "day")
    return counted.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_GAPS = """
WITH days AS (SELECT DISTINCT o_custkey AS person, CAST(o_orderdate AS DATE) AS day FROM orders),
g1 AS (SELECT person, day, date_diff('day', lag(day) OVER w, day) AS d1,
              count(*) OVER (PARTITION BY person) AS n FROM days
       WINDOW w AS (PARTITION BY person ORDER BY day)),
g2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY person ORDER BY day) AS d2 FROM g1)
"""


@query(
    "w4_day_gaps",
    _GAPS
    + "SELECT person, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n = 1 THEN -1 ELSE d1 END "
    "AS gap FROM g2 WHERE n = 1 OR d1 IS NOT NULL",
)
def day_gaps(t: Tables):
    orders = t.orders.select(
        F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day")
    )
    gaps = ent.day_gaps(orders, "person", "day")
    return gaps.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "w4_day_gaps_second_order",
    _GAPS
    + "SELECT person, strftime(day, '%Y-%m-%d') AS day, CASE WHEN n = 1 THEN -1 ELSE d2 END "
    "AS gap FROM g2 WHERE n = 1 OR d2 IS NOT NULL",
)
def day_gaps_second_order(t: Tables):
    orders = t.orders.select(
        F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day")
    )
    gaps = ent.day_gaps(orders, "person", "day", order=2)
    return gaps.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "w5_gap_statistics",
    _GAPS
    + "SELECT person, round(avg(gap), 6) AS gap_mean, round(stddev_pop(gap), 6) AS gap_std FROM "
    "(SELECT person, CASE WHEN n = 1 THEN -1 ELSE d1 END AS gap FROM g2 "
    "WHERE n = 1 OR d1 IS NOT NULL) GROUP BY person",
)
def gap_statistics(t: Tables):
    orders = t.orders.select(
        F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day")
    )
    stats = ent.gap_statistics(orders, "person", "day")
    return stats.withColumns({c: F.round(c, 6) for c in ("gap_mean", "gap_std")})


@query(
    "w6_last_row",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) "
    "WHERE r = 1",
)
def last_row(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ent.last_per_entity(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "w7_first_row",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1",
)
def first_row(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ent.first_per_entity(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "w8_positions",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position "
    "FROM orders",
)
def positions(t: Tables):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return rk.with_position(t.orders.select("o_orderkey", "o_totalprice"), order, "position").drop(
        "o_totalprice"
    )


@query(
    "r4_venue_risk",
    "WITH "
    + VISITS_SQL
    + "SELECT venue, count(DISTINCT person) AS weight FROM visits JOIN customer "
    "ON person = c_custkey WHERE c_acctbal < 0 GROUP BY venue",
)
def venue_risk(t: Tables):
    return ent.venue_risk(visits(t, text=False), debtors(t), "person", "venue", "label")


def debtors(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("person"), (F.col("c_acctbal") < 0).cast("int").alias("label")
    )


@query(
    "r5_entity_risk",
    "WITH "
    + VISITS_SQL
    + ", risk AS (SELECT venue, count(DISTINCT person) AS weight FROM visits JOIN customer "
    "ON person = c_custkey WHERE c_acctbal < -500 GROUP BY venue), "
    "per_venue AS (SELECT person, venue, count(*) AS n FROM visits GROUP BY person, venue) "
    "SELECT person, count(weight) AS venue_risk_kinds, "
    "CAST(sum(CASE WHEN weight IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS venue_risk_records, "
    "CAST(sum(coalesce(weight, 0)) AS BIGINT) AS venue_risk_weights "
    "FROM per_venue LEFT JOIN risk ON per_venue.venue = risk.venue GROUP BY person",
)
def entity_risk(t: Tables):
    labels = t.customer.select(
        F.col("c_custkey").alias("person"), (F.col("c_acctbal") < -500).cast("int").alias("label")
    )
    cells = visits(t, text=False).groupBy("person", "venue").agg(F.count(F.lit(1)).alias("n"))
    cells = pin(cells, "person-venues")
    risk = ent.venue_risk(cells, labels, "person", "venue", "label")
    return ent.entity_risk(cells, risk, "person", "venue", count="n")
