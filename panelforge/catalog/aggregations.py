"""Grouped statistics, profiles and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.catalog.scalars import price_band
from panelforge.catalog.views import (
    BASE_YEAR,
    HOUSES_SQL,
    SALES_SQL,
    VISITS_SQL,
    houses,
    sales,
    visits,
)
from panelforge.functions import ratios as ra
from panelforge.functions import recode
from panelforge.functions import scalars as sc
from panelforge.operators import aggregates as ag
from panelforge.operators import profile as pr
from panelforge.operators.quantiles import exact_medians, exact_quantiles
from panelforge.plans import presets
from panelforge.sources import Tables


def rounded(df, digits: int, *columns: str):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def rounded_by(df, digits: dict[str, int]):
    """Round many columns in one projection."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


_PANEL_MEASURES = ["sale_quantity", "p_size", "l_discount"]


@query(
    "a1_panel_statistics",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sale_date // 100 - 1994 AS year_delta, "
    "CAST(sale_date % 100 AS INTEGER) AS month, "
    + ", ".join(
        f"round(sum({c}), 4) AS sum_{c}, round(avg({c}), 9) AS mean_{c}, "
        f"round(coalesce(stddev_samp({c}), 0), 9) AS std_{c}"
        for c in ("sale_quantity", "l_discount")
    )
    + ", CAST(sum(p_size) AS BIGINT) AS sum_p_size, round(avg(p_size), 9) AS mean_p_size, "
    "round(coalesce(stddev_samp(p_size), 0), 9) AS std_p_size, "
    "count(DISTINCT sale_quantity) AS record_num FROM sales "
    "GROUP BY class_id, year_delta, month",
)
def panel_statistics(t: Tables):
    rows = sales(t).withColumns(
        {
            "year_delta": sc.year_offset("sale_date", BASE_YEAR),
            "month": sc.period_month("sale_date"),
        }
    )
    panel = ag.panel_statistics(
        rows, ["class_id", "year_delta", "month"], _PANEL_MEASURES, record_of="sale_quantity"
    )
    nines = [f"{s}_{c}" for c in _PANEL_MEASURES for s in ("mean", "std")]
    return rounded(rounded(panel, 9, *nines), 4, "sum_sale_quantity", "sum_l_discount")


@query(
    "a2_total_per_key",
    "WITH " + SALES_SQL + "SELECT class_id, sum(sale_quantity) AS total FROM sales GROUP BY class_id",
)
def total_per_key(t: Tables):
    return ag.totals(sales(t), ["class_id"], "sale_quantity", "total")


@query(
    "a3_distinct_count_per_key",
    "WITH "
    + VISITS_SQL
    + "SELECT person, count(DISTINCT venue) AS hospital_kinds FROM visits GROUP BY person",
)
def distinct_count_per_key(t: Tables):
    return visits(t, text=False).groupBy("person").agg(F.count_distinct("venue").alias("hospital_kinds"))


@query(
    "a4_non_null_count_per_key",
    "WITH " + HOUSES_SQL + "SELECT neighborhood, count(frontage) AS n_frontage, "
    "count(zone) AS n_zone FROM houses GROUP BY neighborhood",
)
def non_null_count_per_key(t: Tables):
    return ag.statistics(
        houses(t), ["neighborhood"], ["frontage", "zone"], ["count"], "n_{column}"
    )


@query(
    "a5_row_count_per_key",
    "SELECT user_id, count(*) AS records_num FROM events GROUP BY user_id",
)
def row_count_per_key(t: Tables):
    return ag.value_counts(t.events, "user_id", "records_num")


@query(
    "a6_flag_sum_per_key",
    "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) "
    "AS clicks FROM events GROUP BY user_id",
)
def flag_sum_per_key(t: Tables):
    flagged = t.events.select("user_id", recode.flag("event_type", "click").alias("clicked"))
    return ag.totals(flagged, ["user_id"], "clicked", "clicks")


@query(
    "a7_kind_block",
    "SELECT p_brand, count(DISTINCT code) AS price_kinds, count(code) AS price_record_num, "
    "CAST(sum(code) AS BIGINT) AS price_type, count(DISTINCT small) AS charge_kinds, "
    "count(small) AS charge_record_num, CAST(sum(small) AS BIGINT) AS charge_type, "
    "count(DISTINCT p_type) AS gbt_kinds, count(p_type) AS gbt_record_num FROM "
    "(SELECT *, CASE p_size WHEN 10 THEN 4 WHEN 15 THEN 5 WHEN 20 THEN 6 END AS code, "
    "CAST(p_type = 'SMALL' AS INTEGER) AS small FROM part) GROUP BY p_brand",
)
def kind_block(t: Tables):
    parts = t.part.select(
        "p_brand",
        "p_type",
        recode.flag("p_type", "SMALL").alias("small"),
        recode.ordinal(price_band(), presets.PRICE_LEVEL_CODES).alias("code"),
    )
    return ag.kind_block(
        parts,
        ["p_brand"],
        {"code": "price", "small": "charge", "p_type": "gbt"},
        summed=["code", "small"],
    )


@query(
    "a8_mean_without_target",
    "WITH " + HOUSES_SQL + "SELECT neighborhood, round(avg(frontage), 4) AS mean_frontage, "
    "round(avg(area), 4) AS mean_area, round(avg(condition), 4) AS mean_condition FROM houses "
    "GROUP BY neighborhood",
)
def mean_without_target(t: Tables):
    means = ag.mean_by(houses(t), ["neighborhood"], ["frontage", "area", "condition", "price"])
    return rounded(means.drop("mean_price"), 4, "mean_frontage", "mean_area", "mean_condition")


@query(
    "a9_frames_by_class",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sum(sale_quantity) AS sum_sale_quantity, "
    "round(avg(sale_quantity), 5) AS mean_sale_quantity, "
    "round(coalesce(stddev_samp(sale_quantity), 0), 5) AS std_sale_quantity FROM sales "
    "GROUP BY class_id",
)
def frames_by_class(t: Tables):
    frames = ag.panel_statistics(sales(t), ["class_id"], ["sale_quantity"])
    return rounded(frames, 5, "mean_sale_quantity", "std_sale_quantity")


@query(
    "a10_mean_by_class",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, round(avg(sale_quantity), 5) AS mean_sale_quantity FROM sales "
    "GROUP BY class_id",
)
def mean_by_class(t: Tables):
    return rounded(ag.mean_by(sales(t), ["class_id"], ["sale_quantity"]), 5, "mean_sale_quantity")


def _mode_sql(table: str, key: str, column: str) -> str:
    return (
        f"(SELECT {key} AS k, {column} FROM (SELECT {key}, {column}, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS r FROM {table} "
        f"WHERE {column} IS NOT NULL GROUP BY {key}, {column}) WHERE r = 1)"
    )


@query(
    "a11_most_frequent_per_key",
    "SELECT o_custkey, a.o_orderpriority, b.o_orderstatus FROM (SELECT DISTINCT o_custkey "
    f"FROM orders) LEFT JOIN {_mode_sql('orders', 'o_custkey', 'o_orderpriority')} a "
    f"ON a.k = o_custkey LEFT JOIN {_mode_sql('orders', 'o_custkey', 'o_orderstatus')} b "
    "ON b.k = o_custkey",
)
def most_frequent_per_key(t: Tables):
    return ag.most_frequent(t.orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


_WIDE = ("drug", "claimed", "paid", "exam")


@query(
    "a12_wide_statistics",
    "WITH "
    + VISITS_SQL
    + "SELECT person, "
    + ", ".join(
        f"CAST(sum({c}) AS DOUBLE) AS {c}_sum, "
        f"round(CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0), 6) AS {c}_mean, "
        f"round(stddev_samp({c}::DOUBLE), 4) AS {c}_std"
        for c in _WIDE
    )
    + " FROM visits GROUP BY person",
)
def wide_statistics(t: Tables):
    stats = ag.statistics(visits(t, text=False), ["person"], _WIDE)
    stats = rounded(stats, 6, *[f"{c}_mean" for c in _WIDE])
    stats = rounded(stats, 4, *[f"{c}_std" for c in _WIDE])
    return stats.withColumns({f"{c}_sum": F.col(f"{c}_sum").cast("double") for c in _WIDE})


_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


@query(
    "a24_correlation_matrix",
    "SELECT col_a, col_b, round(r, 6) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CASE WHEN stddev_samp({a}) > 0 "
        f"AND stddev_samp({b}) > 0 THEN covar_samp({a}, {b}) / "
        f"(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
        f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END)) END AS r "
        "FROM (SELECT * REPLACE (nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount)"
        " FROM lineitem)"
        for a in _NUMBERS
        for b in _NUMBERS
    )
    + ")",
)
def correlation_matrix(t: Tables):
    gaps = {c: F.nullif(c, F.lit(0.0)) for c in ("l_tax", "l_discount")}
    lines = t.lineitem.withColumns(gaps)
    return rounded(pr.correlation_matrix(lines, _NUMBERS), 6, "r")


@query(
    "a24_correlation_matrix_wide",
    "WITH w AS (SELECT "
    + ", ".join(f"l_quantity * {i} + l_discount * {(i * 7) % 12} AS v{i}" for i in range(1, 13))
    + " FROM lineitem) SELECT col_a, col_b, round(r, 6) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT 'v{a}' AS col_a, 'v{b}' AS col_b, "
        f"covar_samp(v{a}, v{b}) / (stddev_samp(v{a}) * stddev_samp(v{b})) AS r FROM w"
        for a in range(1, 13)
        for b in range(1, 13)
    )
    + ")",
)
def correlation_matrix_wide(t: Tables):
    wide = t.lineitem.select(
        *[
            (F.col("l_quantity") * i + F.col("l_discount") * ((i * 7) % 12)).alias(f"v{i}")
            for i in range(1, 13)
        ]
    )
    return rounded(pr.correlation_matrix(wide), 6, "r")


_GAPPY = 40


@query(
    "a24_correlation_matrix_gaps",
    "WITH w AS (SELECT "
    + ", ".join(
        f"CASE WHEN l_linenumber % {3 + 2 * (i % 2)} <> {i % 3} THEN l_quantity * {i} + l_discount * {(i * 7) % 12} "
        f"* 100 + l_linenumber * {i % 5} END AS v{i}"
        for i in range(_GAPPY)
    )
    + " FROM lineitem) SELECT c.a AS col_a, c.b AS col_b, round(c.r, 6) AS r FROM (SELECT unnest(["
    + ", ".join(
        f"{{'a': 'v{a}', 'b': 'v{b}', 'r': CASE WHEN regr_sxx(v{a}, v{b}) > 0 AND regr_syy(v{a}, v{b}) > 0 "
        f"THEN corr(v{a}, v{b}) END}}"
        for a in range(_GAPPY)
        for b in range(_GAPPY)
    )
    + "]) AS c FROM w)",
)
def correlation_matrix_gaps(t: Tables):
    line = F.col("l_linenumber")
    value = F.col("l_quantity").cast("double")
    wide = t.lineitem.select(
        *[
            F.when(
                line % (3 + 2 * (i % 2)) != i % 3,
                value * i + F.col("l_discount") * ((i * 7) % 12) * 100 + line * (i % 5),
            ).alias(f"v{i}")
            for i in range(_GAPPY)
        ]
    )
    return rounded(pr.correlation_matrix(wide), 6, "r")


@query(
    "a24_correlation_constant_columns",
    "SELECT col_a, col_b, CASE WHEN col_a = 'l_tax' AND col_b = 'l_tax' THEN 1.0::DOUBLE END AS r "
    "FROM (SELECT unnest(['l_tax'] || list_transform(range(11), lambda i: 'k' || i)) AS col_a), "
    "(SELECT unnest(['l_tax'] || list_transform(range(11), lambda i: 'k' || i)) AS col_b)",
)
def correlation_constant_columns(t: Tables):
    lines = t.lineitem.select("l_tax", *[F.lit(float(i)).alias(f"k{i}") for i in range(11)])
    return rounded(pr.correlation_matrix(lines), 6, "r")


@query(
    "a25_skewness",
    "SELECT \"column\", round(skew, 6) AS skew FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", avg(pow({c} - m_{c}, 3)) / pow(var_pop({c}), 1.5) AS skew "
        f"FROM orders, (SELECT avg({c}) AS m_{c} FROM orders)"
        for c in ("o_totalprice", "o_custkey")
    )
    + ") ORDER BY skew DESC",
)
def skewness(t: Tables):
    table = pr.skew_table(t.orders, ["o_totalprice", "o_custkey"])
    return rounded(table, 6, "skew").orderBy(F.col("skew").desc())


_GAPPED = ("id", "neighborhood", "zone", "frontage", "area", "quality", "condition", "price")


@query(
    "a26_missing_report",
    "WITH "
    + HOUSES_SQL
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(100.0 * count(CASE WHEN {c} IS NULL THEN 1 END) "
        "/ count(*), 6) AS missing_pct FROM houses"
        for c in _GAPPED
    )
    + ") WHERE missing_pct > 0 ORDER BY missing_pct DESC, \"column\" LIMIT 30",
)
def missing_report(t: Tables):
    return rounded(pr.missing_report(houses(t)), 6, "missing_pct")


@query(
    "a27_normal_fit",
    "SELECT round(avg(o_totalprice), 3) AS mu, round(stddev_pop(o_totalprice), 3) AS sigma "
    "FROM orders",
)
def normal_fit(t: Tables):
    return rounded(pr.normal_fit(t.orders, "o_totalprice"), 3, "mu", "sigma")


@query(
    "a28_density_table",
    "WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 40.0 "
    "AS w, count(*) AS n_all FROM orders) SELECT bin, round(any_value(lo + bin * w), 4) AS low, "
    "round(any_value(lo + (bin + 1) * w), 4) AS high, count(*) AS n, "
    "round(count(*) / any_value(n_all * w), 12) AS density FROM (SELECT CAST(least(floor("
    "(o_totalprice - lo) / w), 39) AS INTEGER) AS bin, lo, w, n_all FROM orders, s) GROUP BY bin",
)
def density_table(t: Tables):
    table = pr.density_table(t.orders, "o_totalprice", bins=40)
    return rounded(rounded(table, 4, "low", "high"), 12, "density")


@query(
    "a28_kernel_density",
    "WITH s AS (SELECT *, lo - 3 * h AS g0, (hi - lo + 6 * h) / 99 AS step FROM (SELECT min(o_totalprice)::DOUBLE AS lo, "
    "max(o_totalprice)::DOUBLE AS hi, count(*) AS n, stddev_samp(o_totalprice) * pow(count(*), -0.2) AS h FROM orders)), "
    "placed AS (SELECT (o_totalprice - g0) / step AS pos, CAST(least(floor((o_totalprice - g0) / step), 98) AS INTEGER) AS k "
    "FROM orders, s), w AS (SELECT k, sum(w) AS w FROM (SELECT k, k + 1 - pos AS w FROM placed UNION ALL "
    "SELECT k + 1, pos - k FROM placed) GROUP BY k) "
    "SELECT p.i::INTEGER AS point, round(any_value(g0 + p.i * step), 4) AS x, "
    "round(sum(w * exp(-0.5 * pow((p.i - k) * step / h, 2))) / any_value(n * h * sqrt(2 * pi())), 12) AS density "
    "FROM w, s, range(100) p(i) GROUP BY p.i",
)
def kernel_density(t: Tables):
    table = pr.kernel_density(t.orders, "o_totalprice", points=100)
    return rounded(rounded(table, 4, "x"), 12, "density")


def _poly_sql(coefficients, x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


_QUANTILES_SQL = f"""
WITH placed AS (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i,
         count(*) OVER () AS n FROM orders),
p AS (SELECT *, CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n)
                ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM placed),
t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS t, p - 0.5 AS q,
             (p - 0.5) * (p - 0.5) AS r FROM p),
quantiles AS (
  SELECT o_orderkey, o_totalprice AS value,
         CASE WHEN least(p, 1 - p) < {pr._TAIL} THEN sign(0.5 - p) *
              {_poly_sql(pr._TAIL_NUM, "t")} / {_poly_sql(pr._TAIL_DEN, "t")}
         ELSE q * {_poly_sql(pr._CENTRE_NUM, "r")} / {_poly_sql(pr._CENTRE_DEN, "r")} END
         AS theoretical FROM t)
"""


@query(
    "a29_normal_quantiles",
    _QUANTILES_SQL + "SELECT o_orderkey, value, round(theoretical, 7) AS theoretical FROM quantiles",
)
def normal_quantiles(t: Tables):
    return rounded(pr.normal_quantiles(t.orders, "o_totalprice", "o_orderkey"), 7, "theoretical")


@query(
    "a29_normal_line",
    _QUANTILES_SQL
    + "SELECT round(regr_slope(value, theoretical), 4) AS slope, "
    "round(regr_intercept(value, theoretical), 4) AS intercept, "
    "round(corr(value, theoretical), 7) AS r FROM quantiles",
)
def normal_line(t: Tables):
    line = pr.normal_line(pr.normal_quantiles(t.orders, "o_totalprice", "o_orderkey"))
    return rounded(rounded(line, 4, "slope", "intercept"), 7, "r")


@query(
    "a30_mean_median_mode",
    "WITH "
    + HOUSES_SQL
    + "SELECT round(avg(area), 4) AS mean_area, round(median(area), 4) AS median_area, "
    "(SELECT zone FROM houses WHERE zone IS NOT NULL GROUP BY zone ORDER BY count(*) DESC, zone "
    "LIMIT 1) AS mode_zone FROM houses",
)
def mean_median_mode(t: Tables):
    h = houses(t)
    return h.agg(F.round(F.avg("area"), 4).alias("mean_area")).select(
        "mean_area",
        F.round(exact_medians(h, [], ["area"]).scalar(), 4).alias("median_area"),
        ag.most_frequent(h, [], ["zone"]).scalar().alias("mode_zone"),
    )


@query(
    "a30_exact_quantiles_per_group",
    "SELECT l_returnflag, "
    + ", ".join(
        f"round(quantile_cont({c}, {p}), 6) AS {c}_{int(p * 100)}"
        for c in ("l_extendedprice", "l_quantity")
        for p in (0.25, 0.5, 0.75)
    )
    + " FROM lineitem GROUP BY l_returnflag",
)
def exact_quantiles_per_group(t: Tables):
    columns, cuts = ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75]
    q = exact_quantiles(t.lineitem, ["l_returnflag"], columns, cuts)
    return q.select(
        "l_returnflag",
        *[
            F.round(F.col(c)[i], 6).alias(f"{c}_{int(p * 100)}")
            for c in columns
            for i, p in enumerate(cuts)
        ],
    )


@query(
    "a33_value_counts",
    "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey",
)
def value_counts(t: Tables):
    return ag.value_counts(t.lineitem, "l_suppkey")


# ---------------------------------------------------------------------------------- ratios


@query(
    "r1_safe_ratio",
    "WITH "
    + VISITS_SQL
    + ", s AS (SELECT visit, CAST(sum(claimed) AS DOUBLE) AS claimed, "
    "CAST(sum(paid) AS DOUBLE) AS paid FROM visits GROUP BY visit) "
    "SELECT visit, CASE WHEN paid <> 0 THEN round(claimed / paid, 6) WHEN claimed <> 0 THEN 2 "
    "ELSE 0 END AS ratio FROM s",
)
def safe_ratio(t: Tables):
    sums = visits(t, text=False).groupBy("visit").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("claimed", "paid")]
    )
    return sums.select("visit", F.round(ra.safe_ratio("claimed", "paid"), 6).alias("ratio"))


@query(
    "r2_share_of_total",
    "WITH "
    + VISITS_SQL
    + ", s AS (SELECT person, CAST(sum(drug) AS DOUBLE) AS drug, CAST(sum(claimed) AS DOUBLE) "
    "AS claimed, CAST(coalesce(sum(exam), 0) AS DOUBLE) AS exam FROM visits GROUP BY person) "
    "SELECT person, round(drug + exam, 2) AS total, round(claimed / (drug + exam), 6) AS share "
    "FROM s",
)
def share_of_total(t: Tables):
    sums = visits(t, text=False).groupBy("person").agg(
        *[F.sum(c).cast("double").alias(c) for c in ("drug", "claimed", "exam")]
    )
    total = ra.null_as_zero_sum("drug", "exam")
    return sums.select(
        "person",
        F.round(total, 2).alias("total"),
        F.round(ra.share(F.col("claimed"), total), 6).alias("share"),
    )


@query(
    "r3_off_fund_share",
    "WITH "
    + VISITS_SQL
    + ", s AS (SELECT person, avg(drug::DOUBLE) AS fund, avg(claimed::DOUBLE) AS account, "
    "avg(paid::DOUBLE) AS other FROM visits GROUP BY person) SELECT person, "
    "round((account + other) / (fund + account + other), 6) AS off_fund FROM s",
)
def off_fund_share(t: Tables):
    means = visits(t, text=False).groupBy("person").agg(
        F.avg(F.col("drug").cast("double")).alias("fund"),
        F.avg(F.col("claimed").cast("double")).alias("account"),
        F.avg(F.col("paid").cast("double")).alias("other"),
    )
    outside = F.col("account") + F.col("other")
    return means.select(
        "person", F.round(ra.share(outside, F.col("fund") + outside), 6).alias("off_fund")
    )
