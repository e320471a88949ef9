"""Whole feature tables, models and forecasts.

A linear model of one column has a closed solution, so those queries have SQL counterparts;
tree ensembles have none and are covered by tests of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.catalog.aggregations import rounded, rounded_by
from panelforge.catalog.registry import query
from panelforge.catalog.views import (
    BASE_YEAR,
    FEE_SQL,
    FIRST_PERIOD,
    HOUSES_SQL,
    SALES_SQL,
    TARGET_PERIOD,
    VISITS_SQL,
    billed,
    charged,
    fee_lines,
    houses,
    sales,
    visits,
)
from panelforge.models import (
    AdaBoostR2,
    AveragingRegressor,
    HuberBoosting,
    KernelRidge,
    PolynomialRidge,
    StackingRegressor,
    blend,
    elastic_net,
    gradient_boosting,
    histogram_boosting,
    lasso,
    leaf_wise_boosting,
    random_forest,
    regularised_boosting,
    second_order_boosting,
    sgd_linear,
)
from panelforge.models import validation as va
from panelforge.models.ensemble import predict
from panelforge.models.jobs import kept
from panelforge.models.linear import PENALTIES
from panelforge.operators import ranking as rk
from panelforge.operators.aggregates import rmse
from panelforge.operators.columns import numeric_columns
from panelforge.operators.entity import venue_risk
from panelforge.operators.filters import after
from panelforge.operators.impute import FillPolicy
from panelforge.plans import claims, listings, panel, presets
from panelforge.session import forget_shuffles, pin
from panelforge.sources import Tables

# -------------------------------------------------------------------------- feature tables

PANEL_ROLES = panel.PanelRoles(
    categories=["l_returnflag", "l_linestatus", "p_type", "p_brand"],
    measures=["p_retailprice", "p_size", "l_extendedprice", "l_discount", "l_tax"],
    base_year=BASE_YEAR,
    first_period=FIRST_PERIOD,
)

#: The fits of ``panel_forecast`` take minutes over all columns, so that query keeps to these.
FORECAST_ROLES = panel.PanelRoles(
    categories=PANEL_ROLES.categories[:2],
    measures=["p_size", "l_discount"],
    base_year=BASE_YEAR,
    first_period=FIRST_PERIOD,
)

# What the categories of the test tables hold.
_PANEL_VOCABULARY = {
    "l_returnflag": ["A", "N", "R"],
    "l_linestatus": ["F", "O"],
    "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "p_brand": [f"Brand#{i}" for i in range(1, 26)],
}
_PANEL_VALUES = {
    **{m: m for m in ("sale_quantity", *PANEL_ROLES.measures)},
    **{f"{c}_{v}": f"CAST({c} = '{v}' AS INTEGER)" for c, values in _PANEL_VOCABULARY.items() for v in values},
}

_RECENT_SQL = SALES_SQL + f", recent AS (SELECT * FROM sales WHERE sale_date > {FIRST_PERIOD})"
_RANKS_SQL = """, ranks AS (
  SELECT class_id, row_number() OVER (ORDER BY total, class_id DESC) AS class_trans FROM
  (SELECT class_id, sum(sale_quantity) AS total FROM recent GROUP BY class_id))
"""


def _panel_records(t: Tables) -> DataFrame:
    return panel.gather_records(sales(t), None, PANEL_ROLES)


@query(
    "panel_feature_table",
    "WITH "
    + _RECENT_SQL
    + _RANKS_SQL
    + f"SELECT class_trans, sale_date // 100 - {BASE_YEAR} AS year_delta, "
    "CAST(sale_date % 100 AS INTEGER) AS month, "
    + ", ".join(
        f'round(sum({e})::DOUBLE, 4) AS "sum_{c}", round(avg({e}), 6) AS "mean_{c}", '
        f'round(coalesce(stddev_samp({e}), 0), 5) AS "std_{c}"'
        for c, e in _PANEL_VALUES.items()
    )
    + ", count(DISTINCT sale_quantity) AS record_num FROM recent JOIN ranks USING (class_id) "
    "GROUP BY class_trans, sale_date",
)
def panel_feature_table(t: Tables):
    table, _ = panel.build_panel(_panel_records(t), PANEL_ROLES)
    digits = {"sum": 4, "mean": 6, "std": 5}
    return rounded_by(table, {f"{s}_{c}": n for s, n in digits.items() for c in _PANEL_VALUES})


VISIT_ROLES = claims.VisitRoles(
    person="person",
    venue="venue",
    day="day",
    text="text",
    special="small",
    registration="promo",
    amounts=["drug", "claimed", "paid", "exam"],
    cell_measures=["drug", "claimed", "exam"],
    ratios={"claimed_rate": ("claimed", "drug"), "paid_rate": ("paid", "claimed")},
    total_of=["drug", "exam"],
    shares={"paid_share": "paid"},
    fund="drug",
    account="claimed",
    off_account="paid",
)

_AMOUNTS, _CELLS = VISIT_ROLES.amounts, VISIT_ROLES.cell_measures


def _cell_stats_sql(suffix: str) -> str:
    sums = [
        f"coalesce(stddev_samp({c}::DOUBLE), 0) AS {c}_std_{suffix}, "
        f"CAST(sum({c}) AS DOUBLE) / count({c}) AS {c}_mean_{suffix}, "
        f"max({c})::DOUBLE AS {c}_max_{suffix}, median({c}::DOUBLE) AS {c}_median_{suffix}"
        for c in _CELLS
    ]
    flags = [
        f"coalesce(max({c}) FILTER (texts > 0), 0) AS {c}_max_{suffix}, "
        f"coalesce(median({c}) FILTER (texts > 0), 0)::DOUBLE AS {c}_median_{suffix}, "
        f"coalesce(avg({c}) FILTER (texts > 0), 0) AS {c}_mean_{suffix}, "
        f"coalesce(stddev_samp({c}) FILTER (texts > 0), 0) AS {c}_std_{suffix}"
        for c in ("special", "registration")
    ]
    return ", ".join(sums + flags)


def _cells_sql(bucket: str) -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _CELLS)
    return (
        f"(SELECT person, {bucket} AS bucket, {sums}, "
        "CAST(sum(CASE WHEN contains(text, 'small') THEN 1 ELSE 0 END) AS BIGINT) AS special, "
        "CAST(sum(CASE WHEN contains(text, 'promo') AND NOT contains(text, 'small') THEN 1 "
        "ELSE 0 END) AS BIGINT) AS registration, count(text) AS texts FROM visits GROUP BY 1, 2)"
    )


_CLAIMS_SQL = (
    "WITH "
    + VISITS_SQL
    + ", risk AS (SELECT venue, count(DISTINCT person) AS weight FROM visits JOIN customer "
    "ON person = c_custkey WHERE c_acctbal < -500 GROUP BY venue), "
    "base AS (SELECT person, "
    + ", ".join(
        f"coalesce(CAST(sum({c}) AS DOUBLE), 0) AS {c}_sum, "
        f"coalesce(CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0), 0) AS {c}_mean, "
        f"coalesce(stddev_samp({c}::DOUBLE), 0) AS {c}_std"
        for c in _AMOUNTS
    )
    + ", CAST(sum(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_split_to_array(text, '\\W+')) "
    "END) AS BIGINT) AS diseases_kinds, count(*) AS records_num FROM visits GROUP BY person), "
    "venues AS (SELECT person, count(*) AS hospital_kinds, count(weight) AS hospital_cheat_kinds, "
    "CAST(sum(CASE WHEN weight IS NOT NULL THEN n ELSE 0 END) AS BIGINT) "
    "AS hospital_cheat_records, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS hospital_cheat_weights "
    "FROM (SELECT person, venue, count(*) AS n FROM visits GROUP BY 1, 2) LEFT JOIN risk "
    "USING (venue) GROUP BY person), "
    f"days AS (SELECT person, {_cell_stats_sql('byday')}, count(*) AS day_records_num, "
    "CASE WHEN count(*) = 1 THEN -1 ELSE avg(gap) END AS gap_mean, "
    "CASE WHEN count(*) = 1 THEN 0 ELSE stddev_pop(gap) END AS gap_std FROM "
    "(SELECT *, date_diff('day', lag(bucket) OVER (PARTITION BY person ORDER BY bucket), bucket) "
    f"AS gap FROM {_cells_sql('day')}) GROUP BY person), "
    f"months AS (SELECT person, {_cell_stats_sql('bymonth')}, count(*) AS month_records_num "
    f"FROM {_cells_sql('month')} GROUP BY person), "
    "joined AS (SELECT *, drug_sum + exam_sum AS total, "
    "CASE WHEN drug_sum <> 0 THEN claimed_sum / drug_sum WHEN claimed_sum <> 0 THEN 2 ELSE 0 END "
    "AS claimed_rate, CASE WHEN claimed_sum <> 0 THEN paid_sum / claimed_sum "
    "WHEN paid_sum <> 0 THEN 2 ELSE 0 END AS paid_rate, "
    "paid_sum / (drug_sum + exam_sum) AS paid_share, "
    "drug_mean + claimed_mean + paid_mean AS paid_total_mean, "
    "(claimed_mean + paid_mean) / (drug_mean + claimed_mean + paid_mean) AS off_fund_rate_mean, "
    "drug_std + claimed_std + paid_std AS paid_total_std "
    "FROM base JOIN venues USING (person) JOIN days USING (person) JOIN months USING (person))"
)

_CLAIMS_INTEGERS = (
    ["person", "diseases_kinds", "records_num", "hospital_kinds", "hospital_cheat_kinds"]
    + ["hospital_cheat_records", "hospital_cheat_weights", "day_records_num", "month_records_num"]
    + [f"{f}_max_{s}" for f in ("special", "registration") for s in ("byday", "bymonth")]
)
_CLAIMS_REALS = (
    [f"{c}_{s}" for c in _AMOUNTS for s in ("sum", "mean", "std")]
    + [f"{c}_{s}_{b}" for c in _CELLS for s in ("std", "mean", "max", "median") for b in ("byday", "bymonth")]
    + [f"{c}_{s}_{b}" for c in ("special", "registration") for s in ("median", "mean", "std") for b in ("byday", "bymonth")]
    + ["gap_mean", "gap_std", "total", "claimed_rate", "paid_rate", "paid_share"]
    + ["paid_total_mean", "off_fund_rate_mean", "paid_total_std"]
)


def _claims_digits(name: str) -> int:
    if "std" in name:
        return 3
    return 6 if "mean" in name else 5


def _claims_select(source: str) -> str:
    reals = [f"round({c}::DOUBLE, {_claims_digits(c)}) AS {c}" for c in _CLAIMS_REALS]
    return f"SELECT {', '.join(_CLAIMS_INTEGERS + reals)} FROM {source}"


def _round_claims(df: DataFrame) -> DataFrame:
    return rounded_by(df, {c: _claims_digits(c) for c in _CLAIMS_REALS})


def _risk(t: Tables, records: DataFrame) -> DataFrame:
    labels = t.customer.select(
        F.col("c_custkey").alias("person"), (F.col("c_acctbal") < -500).cast("int").alias("label")
    )
    return venue_risk(records, labels, "person", "venue", "label")


@query("visit_feature_table", _CLAIMS_SQL + _claims_select("joined"))
def visit_feature_table(t: Tables):
    # the joined visits feed four groupings: joined once, then read column by column
    records = pin(visits(t), "visits")
    return _round_claims(claims.visit_features(records, _risk(t, records), VISIT_ROLES))


FEE_ROLES = claims.FeeRoles(
    person="person",
    venue="venue",
    day="day",
    price="unit_price",
    quantity="quantity",
    code="item_code",
    form="form",
)


_FEE_FN = {
    "max": "max({c})",
    "mean": "CAST(sum({c}) AS DOUBLE) / count({c})",
    "std": "stddev_samp({c}::DOUBLE)",
    "median": "median({c}::DOUBLE)",
}


def _fee_digits(name: str) -> int:
    return 3 if name.endswith("std") else 6


def _fee_stats_sql(per: str) -> str:
    parts = []
    for c in ("hospitals", "drug_fee", "drug_counts", "cata3"):
        stats = {"hospitals_perday": "max median", "drug_counts_perday": "max mean"}.get(
            f"{c}_{per}", "max mean std"
        )
        parts += [
            f"round({_FEE_FN[s].format(c=c)}::DOUBLE, {_fee_digits(s)}) AS {c}_{per}_{s}"
            for s in stats.split()
        ]
    return ", ".join(parts)


def _fee_cells_sql(bucket: str) -> str:
    return (
        f"(SELECT person, {bucket} AS bucket, sum(unit_price * quantity) AS drug_fee, "
        "sum(quantity) AS drug_counts, "
        "sum(item_code) AS cata3, count(DISTINCT venue) AS hospitals FROM fee GROUP BY 1, 2)"
    )


def _corr_sql(c: str, name: str) -> str:
    return (
        f"CASE WHEN stddev_samp({c}::DOUBLE) > 0 AND stddev_samp(bucket) > 0 THEN "
        f"round(covar_samp({c}::DOUBLE, bucket) / (stddev_samp({c}::DOUBLE) "
        f"* stddev_samp(bucket)), 6) END "
        f"AS {name}_corrwithday"
    )


_FEE_TABLE_SQL = (
    "WITH "
    + FEE_SQL
    + f", daily AS (SELECT person, {_fee_stats_sql('perday')}, "
    + f"{_corr_sql('drug_counts', 'quantity')}, {_corr_sql('drug_fee', 'drug_fee')}, "
    + f"{_corr_sql('cata3', 'item_code')} FROM "
    + _fee_cells_sql("date_diff('day', DATE '1970-01-01', day)")
    + f" GROUP BY person), monthly AS (SELECT person, {_fee_stats_sql('permonth')} FROM "
    + _fee_cells_sql("month(day)")
    + " GROUP BY person), forms AS (SELECT person, count(form) AS med_kinds_total, "
    "count(DISTINCT form) AS med_kinds_nunique, round((count(form) - count(DISTINCT form)) "
    "/ count(form), 6) AS med_kinds_rep_rate FROM fee WHERE form IS NOT NULL GROUP BY person)"
)


def _fee_table(fees: DataFrame) -> DataFrame:
    table = claims.fee_features(fees, FEE_ROLES)
    digits = {c: _fee_digits(c) for c in table.columns if "_per" in c}
    digits |= {c: 6 for c in table.columns if c.endswith(("corrwithday", "rep_rate"))}
    return rounded_by(table, digits)


@query(
    "fee_feature_table",
    _FEE_TABLE_SQL + " SELECT * FROM daily JOIN monthly USING (person) LEFT JOIN forms USING (person)",
)
def fee_feature_table(t: Tables):
    return _fee_table(fee_lines(t))


@query(
    "claims_feature_table",
    _CLAIMS_SQL
    + ", "
    + _FEE_TABLE_SQL[len("WITH ") :]
    + ", fees AS (SELECT * FROM daily JOIN monthly USING (person) LEFT JOIN forms USING (person)), "
    + f"chosen AS ({_claims_select('joined')}) "
    + "SELECT *, CAST(c_acctbal < -500 AS INTEGER) AS label FROM chosen JOIN fees USING (person) "
    "JOIN (SELECT c_custkey AS person, c_acctbal FROM customer) USING (person)",
)
def claims_feature_table(t: Tables):
    # visits and fees are the same lines of the same orders, joined once
    lines = pin(visits(t, fees=True), "visits")
    forget_shuffles(t.spark)
    records = billed(lines)
    labels = t.customer.select(
        F.col("c_custkey").alias("person"),
        "c_acctbal",
        (F.col("c_acctbal") < -500).cast("int").alias("label"),
    )
    table = claims.claims_table(records, _risk(t, records), _fee_table(charged(lines)), VISIT_ROLES, labels)
    return _round_claims(table)


HOUSE_ROLES = listings.ListingRoles(
    key="id",
    target="price",
    policy=FillPolicy(
        constant={"quality": "None", "area": 0.0},
        mode=["zone"],
        group_median={"frontage": "neighborhood"},
    ),
    as_text=["condition"],
    coded=["quality", "condition"],
    total_name="total_area",
    total_of=["frontage", "area"],
    extra_keys=["neighborhood"],
)

_HOUSE_SQL = (
    "WITH "
    + HOUSES_SQL
    + ", kept AS (SELECT id, neighborhood, zone, frontage, area, quality, "
    "CAST(condition AS VARCHAR) AS condition, CASE WHEN id % 4 <> 0 THEN ln(1 + abs(price)) END "
    "AS price, CASE WHEN id % 4 <> 0 THEN 'train' ELSE 'test' END AS split FROM houses "
    "WHERE NOT (id % 4 <> 0 AND coalesce(area > 9000 AND abs(price) < 9500, false))), "
    "filled AS (SELECT id, neighborhood, price, split, coalesce(zone, (SELECT zone FROM kept "
    "WHERE zone IS NOT NULL GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 1)) AS zone, "
    "coalesce(frontage, median(frontage) OVER (PARTITION BY neighborhood)) AS frontage, "
    "coalesce(area, 0) AS area, coalesce(quality, 'None') AS quality, condition FROM kept), "
    "coded AS (SELECT * REPLACE (dense_rank() OVER (ORDER BY quality) - 1 AS quality, "
    "dense_rank() OVER (ORDER BY condition) - 1 AS condition), frontage + area AS total_area "
    "FROM filled), skews AS (SELECT "
    + ", ".join(
        f"(avg({c}*{c}*{c}) - 3*avg({c})*avg({c}*{c}) + 2*pow(avg({c}), 3)) "
        f"/ pow(var_pop({c}), 1.5) AS s_{c}"
        for c in ("area", "quality", "condition", "frontage", "total_area")
    )
    + " FROM coded) SELECT id, neighborhood, round(price, 6) AS price, split, "
    + ", ".join(
        f"round(CASE WHEN abs(s_{c}) > 0.75 THEN (pow(1 + {c}, 0.15) - 1) / 0.15 "
        f"ELSE {c} END::DOUBLE, 4) AS {c}"
        for c in ("area", "quality", "condition", "frontage", "total_area")
    )
    + ", "
    + ", ".join(
        f"CAST(zone = '{v}' AS INTEGER) AS \"zone_{v}\""
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM coded, skews"
)


def _house_features(t: Tables) -> DataFrame:
    rows = houses(t).withColumn("price", F.abs("price"))
    train, test = rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0")
    outlier = (F.col("area") > 9000) & (F.col("price") < 9500)
    return listings.listing_features(train, test, HOUSE_ROLES, outlier)


@query("house_feature_table", _HOUSE_SQL)
def house_feature_table(t: Tables):
    table = rounded(_house_features(t), 6, "price")
    return rounded(table, 4, "area", "quality", "condition", "frontage", "total_area")


# ------------------------------------------------------------------------------ model table


def cells(t: Tables) -> DataFrame:
    """Monthly quantity ``y`` of each class beside two sizes of its sales, written once."""
    lines = sales(t).groupBy("class_id", "sale_date").agg(
        F.sum("sale_quantity").alias("y"),
        (F.sum("p_size") / F.lit(10.0)).alias("x1"),
        F.count(F.lit(1)).cast("double").alias("x2"),
    )
    return pin(lines, "cells")


def folded_cells(t: Tables, k: int = 5) -> DataFrame:
    order = [F.col("class_id"), F.col("sale_date")]
    return rk.contiguous_folds(cells(t), order, k)


_CELLS_SQL = (
    SALES_SQL
    + ", cells AS (SELECT class_id, sale_date, sum(sale_quantity) AS y, "
    "sum(p_size) / 10.0::DOUBLE AS x1, count(*)::DOUBLE AS x2 FROM sales "
    "GROUP BY class_id, sale_date)"
)
_FOLDED_SQL = (
    _CELLS_SQL
    + ", folded AS (SELECT *, ntile(5) OVER (ORDER BY class_id, sale_date) - 1 AS fold FROM cells), "
    "training AS (SELECT hold, folded.* FROM folded, (SELECT unnest(range(5)) AS hold) "
    "WHERE fold <> hold)"
)


def _fit_sql(name, source, x="x", y="y", absolute=0.0, quadratic=0.0, by="") -> str:
    """One-column penalised least squares: ``(by, w, b)``."""
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (
        f", {name} AS (SELECT {keys}w, my - w * mx AS b FROM (SELECT {keys}"
        f"sign(covar_pop({y}, {x})) * greatest(abs(covar_pop({y}, {x})) - {absolute}, 0) "
        f"/ (var_pop({x}) + {quadratic}) AS w, avg({y}) AS my, avg({x}) AS mx FROM {source}{group}))"
    )


def _scaled_sql(x: str) -> str:
    """``scaled``: the cells with ``x`` centred on its median over its quartile range."""
    return (
        f", q AS (SELECT quantile_cont({x}, [0.25, 0.5, 0.75]) AS q FROM cells), "
        f"scaled AS (SELECT cells.*, ({x} - q[2]) / (q[3] - q[1]) AS x FROM cells, q)"
    )


def _in_sample(df: DataFrame, model, name: str, digits: int = 4) -> DataFrame:
    """Mean prediction and error over the rows the model was fitted on."""
    scored = predict(model, df, "p")
    table = scored.agg(
        F.avg("p").alias("mean_prediction"),
        F.stddev_pop("p").alias("spread"),
        F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("rmse"),
    )
    named = table.withColumn("model", F.lit(name))
    return rounded(named, digits, "mean_prediction", "spread", "rmse")


def _in_sample_sql(name: str, prediction: str, source: str) -> str:
    return (
        f" SELECT '{name}' AS model, round(avg({prediction}), 4) AS mean_prediction, "
        f"round(stddev_pop({prediction}), 4) AS spread, "
        f"round(sqrt(avg(pow(y - ({prediction}), 2))), 4) AS rmse FROM {source}"
    )


@query(
    "m1_lasso",
    "WITH "
    + _CELLS_SQL
    + _scaled_sql("x1")
    + _fit_sql("m", "scaled", absolute=5.0)
    + _in_sample_sql("lasso", "w * x + b", "scaled, m"),
)
def lasso_model(t: Tables):
    rows = cells(t)
    return _in_sample(rows, lasso(["x1"], "y", 5.0).fit(rows), "lasso")


@query(
    "m2_elastic_net",
    "WITH "
    + _CELLS_SQL
    + _scaled_sql("x1")
    + _fit_sql("m", "scaled", absolute=2.0 * 0.9, quadratic=2.0 * (1 - 0.9))
    + _in_sample_sql("elastic_net", "w * x + b", "scaled, m"),
)
def elastic_net_model(t: Tables):
    rows = cells(t)
    return _in_sample(rows, elastic_net(["x1"], "y", 2.0, 0.9).fit(rows), "elastic_net")


@query(
    "m3_polynomial_ridge",
    "WITH "
    + _CELLS_SQL
    + ", mapped AS (SELECT y, sqrt(5.0) * x1 AS u, x1 * x1 AS v FROM cells), "
    "s AS (SELECT covar_pop(y, u) AS cu, covar_pop(y, v) AS cv, covar_pop(u, v) AS uv, "
    "var_pop(u) + 0.6 / count(*) AS uu, var_pop(v) + 0.6 / count(*) AS vv, avg(y) AS my, "
    "avg(u) AS mu, avg(v) AS mv FROM mapped), "
    "m AS (SELECT (cu * vv - cv * uv) / (uu * vv - uv * uv) AS a, "
    "(cv * uu - cu * uv) / (uu * vv - uv * uv) AS c, my, mu, mv FROM s)"
    + _in_sample_sql(
        "polynomial_ridge", "a * (u - mu) + c * (v - mv) + my", "mapped, m"
    ).replace(", 4)", ", 3)"),
)
def polynomial_ridge_model(t: Tables):
    rows = cells(t)
    model = PolynomialRidge(inputCols=["x1"], labelCol="y", alpha=0.6, degree=2, coef0=2.5).fit(rows)
    return _in_sample(rows, model, "polynomial_ridge", digits=3)


# Two landmarks, the least and the largest x1: ridge regression on two kernel values, penalised by their own kernel.
@query(
    "m3_kernel_ridge",
    "WITH "
    + _CELLS_SQL
    + ", z AS (SELECT min(x1) AS z1, max(x1) AS z2 FROM cells), "
    "kerneled AS (SELECT y, pow(x1 * z1 + 12.9155::DOUBLE, 1.1288::DOUBLE) AS u, "
    "pow(x1 * z2 + 12.9155::DOUBLE, 1.1288::DOUBLE) AS v FROM cells, z), "
    "s AS (SELECT covar_pop(y, u) AS cu, covar_pop(y, v) AS cv, "
    "var_pop(u) + 359.38136::DOUBLE / count(*) * any_value(pow(z1 * z1 + 12.9155::DOUBLE, 1.1288::DOUBLE)) AS uu, "
    "covar_pop(u, v) + 359.38136::DOUBLE / count(*) * any_value(pow(z1 * z2 + 12.9155::DOUBLE, 1.1288::DOUBLE)) AS uv, "
    "var_pop(v) + 359.38136::DOUBLE / count(*) * any_value(pow(z2 * z2 + 12.9155::DOUBLE, 1.1288::DOUBLE)) AS vv, "
    "avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM kerneled, z), "
    "m AS (SELECT (cu * vv - cv * uv) / (uu * vv - uv * uv) AS a, "
    "(cv * uu - cu * uv) / (uu * vv - uv * uv) AS c, my, mu, mv FROM s)"
    + _in_sample_sql("kernel_ridge", "a * (u - mu) + c * (v - mv) + my", "kerneled, m").replace(", 4)", ", 3)"),
)
def kernel_ridge_model(t: Tables):
    rows = cells(t)
    ends = rows.agg(F.min("x1"), F.max("x1")).first()
    model = KernelRidge(inputCols=["x1"], labelCol="y", points=[[ends[0]], [ends[1]]], **presets.VEHICLE_KERNEL).fit(rows)
    return _in_sample(rows, model, "kernel_ridge", digits=3)


@query("m3_kernel_ridge_landmarks")
def kernel_ridge_landmarks(t: Tables):
    rows = cells(t)
    model = KernelRidge(inputCols=["x1", "x2"], labelCol="y", **presets.VEHICLE_KERNEL).fit(rows)
    return _in_sample(rows, model, "kernel_ridge_landmarks", digits=3)


# Trees are exact where nothing is drawn at random: one feature with fewer values than bins, depth 1.
_STUMP_ROWS = (
    "WITH r0 AS (SELECT o_orderkey, CAST(month(o_orderdate) AS DOUBLE) AS x, "
    "o_totalprice / 1000 AS y, 1.0::DOUBLE AS w FROM orders)"
)


def stump_rows(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.month("o_orderdate").cast("double").alias("x"),
        (F.col("o_totalprice") / F.lit(1000.0)).alias("y"),
    )


def _stump_sql(source: str, label: str, out: str) -> str:
    """``source`` with ``out``: the prediction of the tree of depth 1 on ``x`` with least squared error."""
    return (
        f", {out}_g AS (SELECT x AS cut, sum(w) AS n, sum(w * ({label})) AS s FROM {source} GROUP BY x), "
        f"{out}_c AS (SELECT cut, sum(n) OVER (ORDER BY cut) AS n_left, sum(s) OVER (ORDER BY cut) AS s_left, "
        f"sum(n) OVER () AS n_all, sum(s) OVER () AS s_all FROM {out}_g), "
        f"{out}_b AS (SELECT cut, s_left / n_left AS below, (s_all - s_left) / (n_all - n_left) AS above "
        f"FROM {out}_c WHERE n_left < n_all ORDER BY s_left * s_left / n_left "
        "+ (s_all - s_left) * (s_all - s_left) / (n_all - n_left) DESC LIMIT 1), "
        f"{out}_r AS (SELECT {source}.*, CASE WHEN x <= cut THEN below ELSE above END AS {out} FROM {source}, {out}_b)"
    )


def _boosted_sql(rate: float) -> str:
    """Two rounds: the second tree learns twice the residual and counts ``rate``."""
    return _STUMP_ROWS + _stump_sql("r0", "y", "p1") + _stump_sql("p1_r", "2 * (y - p1)", "p2") + (
        f" SELECT o_orderkey, round(p1 + {rate} * p2, 6) AS p FROM p2_r"
    )


def _stump_query(t: Tables, model) -> DataFrame:
    rows = stump_rows(t)
    return rounded(predict(model.fit(rows), rows, "p").select("o_orderkey", "p"), 6, "p")


@query(
    "m4_random_forest_stump",
    _STUMP_ROWS + _stump_sql("r0", "y", "p1") + " SELECT o_orderkey, round(p1, 6) AS p FROM p1_r",
)
def random_forest_stump(t: Tables):
    return _stump_query(t, random_forest(["x"], "y", trees=1, depth=1, bootstrap=False))


@query("m5_gradient_boosting_stumps", _boosted_sql(0.193069))
def gradient_boosting_stumps(t: Tables):
    return _stump_query(t, gradient_boosting(["x"], "y", trees=2, depth=1))


def _huber_sql(source: str, out: str, rate: float, quantile: float) -> str:
    """``out``: the residuals ``d`` that one stump of Huber's loss leaves of those in ``source``."""
    clip = "greatest(least({}, turn), -turn)"
    return (
        f", {out}_t AS (SELECT *, (SELECT quantile_cont(abs(d), {quantile}) FROM {source}) AS turn FROM {source})"
        + _stump_sql(f"{out}_t", clip.format("d"), f"{out}_leaf")
        + f", {out}_m AS (SELECT {out}_leaf AS leaf, median(d) AS m FROM {out}_leaf_r GROUP BY leaf), "
        f"{out}_v AS (SELECT leaf, any_value(m) + avg({clip.format('d - m')}) AS v FROM {out}_leaf_r "
        f"JOIN {out}_m ON leaf = {out}_leaf GROUP BY leaf), "
        f"{out} AS (SELECT o_orderkey, x, y, w, d - {rate} * v AS d FROM {out}_leaf_r JOIN {out}_v ON leaf = {out}_leaf)"
    )


@query(
    "m5_huber_boosting_stumps",
    _STUMP_ROWS
    + ", d0 AS (SELECT *, y - (SELECT median(y) FROM r0) AS d FROM r0)"
    + _huber_sql("d0", "d1", 0.5, 0.6)
    + _huber_sql("d1", "d2", 0.5, 0.6)
    + " SELECT o_orderkey, round(y - d, 6) AS p FROM d2",
)
def huber_boosting_stumps(t: Tables):
    """Two rounds whose turn lies at the 0.6-quantile of the absolute residuals."""
    return _stump_query(t, HuberBoosting(inputCols=["x"], labelCol="y", trees=2, depth=1, rate=0.5, quantile=0.6))


@query("m6_regularised_boosting_stumps", _boosted_sql(0.0373))
def regularised_boosting_stumps(t: Tables):
    return _stump_query(t, regularised_boosting(["x"], "y", trees=2, depth=1, row_share=1.0))


@query("m7_histogram_boosting_stumps", _boosted_sql(0.33598))
def histogram_boosting_stumps(t: Tables):
    return _stump_query(t, histogram_boosting(["x"], "y", trees=2, depth=1, row_share=1.0))


# Penalties of the second-order queries: on absolute and squared leaf weights, least gain and least curvature.
_PENALTIES = {"l1": 40.0, "l2": 300.0, "min_gain": 5.0, "min_curvature": 20.0}


def _penalised(gradient: str) -> str:
    return f"(sign({gradient}) * greatest(abs({gradient}) - {_PENALTIES['l1']}, 0))"


def _score(gradient: str, curvature: str) -> str:
    return f"pow({_penalised(gradient)}, 2) / ({curvature} + {_PENALTIES['l2']})"


def _penalised_stump_sql(source: str, k: int, rate: float) -> str:
    """``r{k}``: ``source`` with one more tree of depth 1 in its prediction ``p``."""
    return (
        f", g{k} AS (SELECT x AS cut, sum(p - y) AS g, count(*) AS h FROM {source} GROUP BY x), "
        f"c{k} AS (SELECT cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER () AS ga, sum(h) OVER () AS ha "
        f"FROM g{k} WINDOW w AS (ORDER BY cut)), "
        f"b{k} AS (SELECT *, {_score('gl', 'hl')} + {_score('(ga - gl)', '(ha - hl)')} - {_score('ga', 'ha')} AS gain FROM c{k} "
        f"WHERE hl >= {_PENALTIES['min_curvature']} AND ha - hl >= {_PENALTIES['min_curvature']} ORDER BY gain DESC, cut LIMIT 1), "
        f"r{k} AS (SELECT o_orderkey, x, y, p - {rate} * CASE WHEN gain < {_PENALTIES['min_gain']} THEN {_penalised('ga')} / (ha + {_PENALTIES['l2']}) "
        f"WHEN x <= cut THEN {_penalised('gl')} / (hl + {_PENALTIES['l2']}) "
        f"ELSE {_penalised('(ga - gl)')} / (ha - hl + {_PENALTIES['l2']}) END AS p FROM {source}, b{k})"
    )


@query(
    "m6_second_order_boosting",
    _STUMP_ROWS
    + ", s0 AS (SELECT o_orderkey, x, y, 0.5 AS p FROM r0)"
    + _penalised_stump_sql("s0", 1, 0.5)
    + _penalised_stump_sql("r1", 2, 0.5)
    + " SELECT o_orderkey, round(p, 6) AS p FROM r2",
)
def second_order_stumps(t: Tables):
    return _stump_query(t, second_order_boosting(["x"], "y", trees=2, rate=0.5, depth=1, **_PENALTIES))


def _leaf_step_sql(k: int) -> str:
    """``l{k}``: the segments of ``x`` after the split that gains most among those of ``l{k-1}``."""
    square = "pow({0}, 2) / {1}".format
    return (
        f", c{k} AS (SELECT seg, x, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS ga, sum(h) OVER a AS ha "
        f"FROM l{k - 1} WINDOW w AS (PARTITION BY seg ORDER BY x), a AS (PARTITION BY seg)), "
        f"b{k} AS (SELECT seg AS best, x AS cut FROM c{k} WHERE hl >= 11 AND ha - hl >= 11 "
        f"ORDER BY {square('gl', 'hl')} + {square('(ga - gl)', '(ha - hl)')} - {square('ga', 'ha')} DESC LIMIT 1), "
        f"l{k} AS (SELECT CASE WHEN seg = best AND x > cut THEN {k} ELSE seg END AS seg, x, g, h FROM l{k - 1}, b{k})"
    )


@query(
    "m7_leaf_wise_boosting",
    _STUMP_ROWS
    + ", m AS (SELECT avg(y) AS base FROM r0), "
    "l0 AS (SELECT 0 AS seg, x, sum(base - y) AS g, count(*) AS h FROM r0, m GROUP BY x)"
    + "".join(_leaf_step_sql(k) for k in range(1, 5))
    + ", leaf AS (SELECT seg, sum(g) / sum(h) AS step FROM l4 GROUP BY seg) "
    "SELECT o_orderkey, round(base - 0.33598 * step, 6) AS p FROM r0, m JOIN l4 ON l4.x = r0.x JOIN leaf USING (seg)".replace(
        "FROM r0, m JOIN l4", "FROM r0 CROSS JOIN m JOIN l4"
    ),
)
def leaf_wise_tree(t: Tables):
    return _stump_query(t, leaf_wise_boosting(["x"], "y", trees=1, row_share=1.0))


@query(
    "m8_adaboost_stumps",
    _STUMP_ROWS
    + _stump_sql("r0", "y", "p1")
    + ", e1 AS (SELECT *, abs(p1 - y) AS e FROM p1_r), "
    "s1 AS (SELECT max(e) AS worst, sum(w * e) / max(e) / sum(w) AS loss FROM e1), "
    "r1 AS (SELECT o_orderkey, x, y, p1, loss / (1 - loss) AS beta1, "
    "w * pow(loss / (1 - loss), 1 - e / worst) AS w FROM e1, s1)"
    + _stump_sql("r1", "y", "p2")
    + ", e2 AS (SELECT *, abs(p2 - y) AS e FROM p2_r), "
    "s2 AS (SELECT sum(w * e) / max(e) / sum(w) AS loss FROM e2), "
    "v AS (SELECT o_orderkey, p1, p2, ln(1 / beta1) AS w1, ln((1 - loss) / loss) AS w2 FROM e2, s2) "
    "SELECT o_orderkey, round(CASE WHEN (CASE WHEN p1 <= p2 THEN w1 ELSE w2 END) >= 0.5 * (w1 + w2) "
    "THEN least(p1, p2) ELSE greatest(p1, p2) END, 6) AS p FROM v",
)
def adaboost_stumps(t: Tables):
    return _stump_query(t, AdaBoostR2(inputCols=["x"], labelCol="y", trees=2, depth=1))


@query("m4_random_forest")
def random_forest_model(t: Tables):
    rows = cells(t)
    return _in_sample(rows, random_forest(["x1", "x2"], "y", trees=10, depth=6).fit(rows), "forest")


@query("m5_gradient_boosting")
def gradient_boosting_model(t: Tables):
    rows = cells(t)
    model = gradient_boosting(["x1", "x2"], "y", trees=10).fit(rows)
    return _in_sample(rows, model, "gradient_boosting")


@query("m6_regularised_boosting")
def regularised_boosting_model(t: Tables):
    rows = cells(t)
    model = regularised_boosting(["x1", "x2"], "y", trees=10, rate=0.3).fit(rows)
    return _in_sample(rows, model, "regularised_boosting")


@query("m7_histogram_boosting")
def histogram_boosting_model(t: Tables):
    rows = cells(t)
    model = histogram_boosting(["x1", "x2"], "y", trees=10).fit(rows)
    return _in_sample(rows, model, "histogram_boosting")


@query("m8_adaboost")
def adaboost_model(t: Tables):
    rows = cells(t)
    model = AdaBoostR2(inputCols=["x1", "x2"], labelCol="y", trees=5, seed=1).fit(rows)
    return _in_sample(rows, model, "adaboost")


@query(
    "m9_linear_penalties",
    "WITH "
    + _CELLS_SQL
    + "".join(
        _fit_sql(n, "cells", x="x1", absolute=a, quadratic=q)
        for n, a, q in (("m2", 0.0, 0.5), ("m1", 0.5, 0.0), ("me", 0.5 * 0.15, 0.5 * 0.85))
    )
    + " UNION ALL ".join(
        _in_sample_sql(n, "w * x1 + b", f"cells, {m}")
        for n, m in (("l2", "m2"), ("l1", "m1"), ("elasticnet", "me"))
    ),
)
def linear_penalties(t: Tables):
    rows = cells(t)
    parts = [
        _in_sample(rows, sgd_linear(["x1"], "y", penalty, 0.5).fit(rows), penalty)
        for penalty in ("l2", "l1", "elasticnet")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "m10_cross_validation",
    "WITH "
    + _FOLDED_SQL
    + ", q AS (SELECT hold, quantile_cont(x1, [0.25, 0.5, 0.75]) AS q FROM training GROUP BY hold), "
    "scaled AS (SELECT training.hold, y, (x1 - q[2]) / (q[3] - q[1]) AS x FROM training "
    "JOIN q ON q.hold = training.hold)"
    + _fit_sql("m", "scaled", absolute=1.0, by="hold")
    + _fit_sql("o", "training", x="x2", by="hold")
    + " SELECT 'lasso' AS model, CAST(fold AS INTEGER) AS fold, "
    "round(sqrt(avg(pow(y - (w * (x1 - q[2]) / (q[3] - q[1]) + b), 2))), 4) AS rmse FROM folded "
    "JOIN m ON m.hold = fold JOIN q ON q.hold = fold GROUP BY fold UNION ALL "
    "SELECT 'linear', CAST(fold AS INTEGER), round(sqrt(avg(pow(y - (w * x2 + b), 2))), 4) "
    "FROM folded JOIN o ON o.hold = fold GROUP BY fold",
)
def cross_validation(t: Tables):
    models = {"lasso": lasso(["x1"], "y", 1.0), "linear": sgd_linear(["x2"], "y", "l2", 0.0)}
    return rounded(va.cross_validate(folded_cells(t), models, "y"), 4, "rmse")


_ALPHAS = (0.01, 10.0, 1000.0)


@query(
    "m11_grid_search",
    "WITH "
    + _FOLDED_SQL
    + "".join(_fit_sql(f"m{i}", "training", x="x1", quadratic=a, by="hold") for i, a in enumerate(_ALPHAS))
    + ", scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{{\"alpha\": {a}}}' AS params, avg(r2) AS score FROM (SELECT fold, "
        f"1 - sum(pow(y - (w * x1 + b), 2)) / (var_pop(y) * count(*)) AS r2 FROM folded "
        f"JOIN m{i} ON hold = fold GROUP BY fold)"
        for i, a in enumerate(_ALPHAS)
    )
    + ") SELECT 'ridge' AS model, params, round(score, 6) AS score, "
    "CAST(score = (SELECT max(score) FROM scores) AS INTEGER) AS best FROM scores",
)
def grid_search(t: Tables):
    estimator = sgd_linear(["x1"], "y", "l2")
    alpha = estimator.getStages()[-1].alpha
    table = va.grid_search(
        folded_cells(t), estimator, [{alpha: a} for a in _ALPHAS], "y", folds=5, name="ridge"
    )
    return rounded(table, 6, "score")


_GRID = [(a, n) for a in (0.001, 0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 500.0, 1000.0) for n in PENALTIES]


@query(
    "m11_grid_search_penalties",
    "WITH "
    + _FOLDED_SQL
    + "".join(
        _fit_sql(f"m{i}", "training", x="x1", absolute=a * PENALTIES[n], quadratic=a * (1.0 - PENALTIES[n]), by="hold")
        for i, (a, n) in enumerate(_GRID)
    )
    + ", scores AS ("
    + " UNION ALL ".join(
        f"SELECT '{{\"alpha\": {a}, \"l1Ratio\": {PENALTIES[n]}}}' AS params, avg(r2) AS score FROM (SELECT fold, "
        f"1 - sum(pow(y - (w * x1 + b), 2)) / (var_pop(y) * count(*)) AS r2 FROM folded "
        f"JOIN m{i} ON hold = fold GROUP BY fold)"
        for i, (a, n) in enumerate(_GRID)
    )
    + ") SELECT 'linear' AS model, params, round(score, 6) AS score, "
    "CAST(score = (SELECT max(score) FROM scores) AS INTEGER) AS best FROM scores",
)
def grid_search_penalties(t: Tables):
    """Thirteen strengths of three penalties on five folds, from one scan."""
    estimator = sgd_linear(["x1"], "y", "l2")
    linear = estimator.getStages()[-1]
    grid = [{linear.alpha: a, linear.l1Ratio: PENALTIES[n]} for a, n in _GRID]
    table = va.grid_search(folded_cells(t), estimator, grid, "y", folds=5, name="linear")
    return rounded(table, 6, "score")


@query("m11_grid_search_forest")
def grid_search_forest(t: Tables):
    estimator = random_forest(["x1", "x2"], "y", depth=5)
    trees = estimator.getStages()[-1].numTrees
    grid = va.param_grid(trees=(trees, [5, 10]))
    return va.grid_search(folded_cells(t, 3), estimator, grid, "y", folds=3, name="forest")


@query(
    "m12_model_comparison_linear",
    "WITH "
    + _FOLDED_SQL
    + "".join(
        _fit_sql(f"{x}m{i}", "training", x=x, quadratic=a, by="hold")
        for x in ("x1", "x2")
        for i, a in enumerate(_ALPHAS)
    )
    + ", scores AS ("
    + " UNION ALL ".join(
        f"SELECT 'ridge_{x}' AS model, '{{\"alpha\": {a}}}' AS params, avg(r2) AS score FROM (SELECT fold, "
        f"1 - sum(pow(y - (w * {x} + b), 2)) / (var_pop(y) * count(*)) AS r2 FROM folded "
        f"JOIN {x}m{i} ON hold = fold GROUP BY fold)"
        for x in ("x1", "x2")
        for i, a in enumerate(_ALPHAS)
    )
    + ") SELECT model, params, round(score, 6) AS score FROM scores s "
    "WHERE score = (SELECT max(score) FROM scores o WHERE o.model = s.model)",
)
def model_comparison_linear(t: Tables):
    candidates = {}
    for x in ("x1", "x2"):
        estimator = sgd_linear([x], "y", "l2")
        alpha = estimator.getStages()[-1].alpha
        candidates[f"ridge_{x}"] = (estimator, [{alpha: a} for a in _ALPHAS])
    return rounded(va.compare_models(folded_cells(t), candidates, "y", folds=5), 6, "score")


def _plane_sql(name: str, source: str, by: str = "") -> str:
    """Least squares of ``y`` on ``x1`` and ``x2``."""
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return (
        f", {name}_s AS (SELECT {keys}covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2, var_pop(x1) AS v1, "
        f"var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM {source}{group}), "
        f"{name} AS (SELECT {keys}w1, w2, my - w1 * m1 - w2 * m2 AS b FROM (SELECT *, "
        f"(c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS w1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS w2 FROM {name}_s))"
    )


@query(
    "m14_feature_elimination_linear",
    "WITH "
    + _FOLDED_SQL
    + _plane_sql("p", "training", "hold")
    + _plane_sql("whole", "folded")
    + _fit_sql("a", "training", x="x1", by="hold")
    + _fit_sql("z", "training", x="x2", by="hold")
    + ", e2 AS (SELECT avg(r) AS rmse FROM (SELECT fold, sqrt(avg(pow(y - (w1 * x1 + w2 * x2 + b), 2))) AS r "
    "FROM folded JOIN p ON hold = fold GROUP BY fold)), "
    "ea AS (SELECT avg(r) AS rmse FROM (SELECT fold, sqrt(avg(pow(y - (w * x1 + b), 2))) AS r "
    "FROM folded JOIN a ON hold = fold GROUP BY fold)), "
    "ez AS (SELECT avg(r) AS rmse FROM (SELECT fold, sqrt(avg(pow(y - (w * x2 + b), 2))) AS r "
    "FROM folded JOIN z ON hold = fold GROUP BY fold)), "
    "steps AS (SELECT 2 AS n_features, 'x1,x2' AS features, CASE WHEN abs(w1) <= abs(w2) THEN 'x1' ELSE 'x2' END AS dropped, "
    "e2.rmse FROM e2, whole UNION ALL SELECT 1, CASE WHEN abs(w1) <= abs(w2) THEN 'x2' ELSE 'x1' END, NULL, "
    "CASE WHEN abs(w1) <= abs(w2) THEN ez.rmse ELSE ea.rmse END FROM whole, ea, ez) "
    "SELECT n_features, features, dropped, round(rmse, 5) AS rmse, "
    "CAST(rmse = (SELECT min(rmse) FROM steps) AS INTEGER) AS selected FROM steps",
)
def feature_elimination_linear(t: Tables):
    table = va.eliminate_features(
        folded_cells(t), ["x1", "x2"], "y", lambda names: sgd_linear(names, "y", "l2", 0.0), folds=5
    )
    return rounded(table, 5, "rmse")


@query("m12_model_comparison")
def model_comparison(t: Tables):
    linear = sgd_linear(["x1", "x2"], "y", "l2")
    alpha = linear.getStages()[-1].alpha
    boosted = AdaBoostR2(inputCols=["x1", "x2"], labelCol="y", trees=3, seed=1)
    candidates = {
        "linear": (linear, [{alpha: a} for a in (0.001, 1.0)]),
        "adaboost": (boosted, [{boosted.rate: r} for r in (0.5, 1.0)]),
    }
    return va.compare_models(folded_cells(t, 2), candidates, "y", folds=2)


@query("m14_feature_elimination")
def feature_elimination(t: Tables):
    rows = folded_cells(t, 3).withColumn("x3", (F.col("class_id") % 7).cast("double"))
    return va.eliminate_features(
        rows,
        ["x1", "x2", "x3"],
        "y",
        lambda names: random_forest(names, "y", trees=5, depth=5),
        folds=3,
    )


@query(
    "m15_average_of_models",
    "WITH "
    + _CELLS_SQL
    + _scaled_sql("x1")
    + _fit_sql("m", "scaled", absolute=1.0)
    + _fit_sql("o", "cells", x="x2")
    + _in_sample_sql(
        "average", "(m.w * x + m.b + o.w * x2 + o.b) / 2", "scaled, m, o"
    ),
)
def average_of_models(t: Tables):
    rows = cells(t)
    members = [lasso(["x1"], "y", 1.0), sgd_linear(["x2"], "y", "l2", 0.0)]
    return _in_sample(rows, AveragingRegressor(members).fit(rows), "average")


@query(
    "m16_stacking",
    "WITH "
    + _FOLDED_SQL
    + _fit_sql("m1", "training", x="x1", by="hold")
    + _fit_sql("m2", "training", x="x2", by="hold")
    + ", oof AS (SELECT y, m1.w * x1 + m1.b AS u, m2.w * x2 + m2.b AS v FROM folded "
    "JOIN m1 ON m1.hold = fold JOIN m2 ON m2.hold = fold), "
    "s AS (SELECT covar_pop(y, u) AS cu, covar_pop(y, v) AS cv, covar_pop(u, v) AS uv, "
    "var_pop(u) AS uu, var_pop(v) AS vv, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM oof), "
    "m AS (SELECT (cu * vv - cv * uv) / (uu * vv - uv * uv) AS a, "
    "(cv * uu - cu * uv) / (uu * vv - uv * uv) AS c, my, mu, mv FROM s), "
    "base AS (SELECT y, (SELECT avg(w) FROM m1) * x1 + (SELECT avg(b) FROM m1) AS u, "
    "(SELECT avg(w) FROM m2) * x2 + (SELECT avg(b) FROM m2) AS v FROM cells)"
    + _in_sample_sql("stacked", "a * (u - mu) + c * (v - mv) + my", "base, m"),
)
def stacking(t: Tables):
    rows = folded_cells(t)
    stack = StackingRegressor(folds=5).of(
        [sgd_linear(["x1"], "y", "l2", 0.0), sgd_linear(["x2"], "y", "l2", 0.0)],
        lambda names: sgd_linear(names, "y", "l2", 0.0),
    )
    return _in_sample(rows, stack.fit(rows), "stacked")


@query(
    "m16_out_of_fold_rows",
    "WITH "
    + _FOLDED_SQL
    + _fit_sql("m1", "training", x="x1", by="hold")
    + " SELECT class_id, sale_date, CAST(fold AS INTEGER) AS fold, round(w * x1 + b, 3) AS base_0 "
    "FROM folded JOIN m1 ON hold = fold",
)
def out_of_fold_rows(t: Tables):
    rows = folded_cells(t)
    stack = StackingRegressor(folds=5).of([sgd_linear(["x1"], "y", "l2", 0.0)], lambda names: None)
    unseen = stack.out_of_fold(rows, stack.fit_folds(rows))
    return rounded(unseen.select("class_id", "sale_date", "fold", "base_0"), 3, "base_0")


@query(
    "m17_blend",
    "WITH "
    + _CELLS_SQL
    + " SELECT class_id, sale_date, round(y * 0.7 + x1 * 0.15 + x2 * 0.15, 6) AS blend FROM cells",
)
def weighted_blend(t: Tables):
    weights = dict(zip(("y", "x1", "x2"), presets.BLEND_WEIGHTS, strict=True))
    return rounded(blend(cells(t), weights).select("class_id", "sale_date", "blend"), 6, "blend")


@query(
    "m18_log_target",
    "WITH "
    + _CELLS_SQL
    + ", logged AS (SELECT *, ln(1 + y) AS ly FROM cells)"
    + _fit_sql("m", "logged", x="x2", y="ly")
    + _in_sample_sql("log_target", "exp(w * x2 + b) - 1", "logged, m").replace(", 4)", ", 3)"),
)
def log_target(t: Tables):
    rows = cells(t).withColumn("ly", F.log1p("y"))
    scored = predict(sgd_linear(["x2"], "ly", "l2", 0.0).fit(rows), rows, "lp")
    back = scored.withColumn("p", F.expm1("lp"))
    table = back.agg(
        F.avg("p").alias("mean_prediction"),
        F.stddev_pop("p").alias("spread"),
        F.sqrt(F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))).alias("rmse"),
    ).withColumn("model", F.lit("log_target"))
    return rounded(table, 3, "mean_prediction", "spread", "rmse")


@query(
    "m19_in_sample_score",
    "WITH "
    + _CELLS_SQL
    + _fit_sql("m", "cells", x="x2")
    + " SELECT round(sqrt(avg(pow(y - (w * x2 + b), 2))), 6) AS rmse FROM cells, m",
)
def in_sample_score(t: Tables):
    rows = cells(t)
    scored = predict(sgd_linear(["x2"], "y", "l2", 0.0).fit(rows), rows, "p")
    return rounded(rmse(scored, "y", "p"), 6, "rmse")


@query(
    "m20_submission",
    "WITH "
    + _RECENT_SQL
    + _RANKS_SQL
    + ", panel AS (SELECT class_id, sale_date, sum(sale_quantity) AS y, "
    "sum(p_size)::DOUBLE AS x FROM recent GROUP BY class_id, sale_date), "
    f"train AS (SELECT * FROM panel WHERE sale_date <> {TARGET_PERIOD})"
    + _fit_sql("m", "train")
    + f" SELECT {TARGET_PERIOD} AS predict_date, class_id, round(w * x + b, 4) AS predict_quantity "
    f"FROM panel, m WHERE sale_date = {TARGET_PERIOD}",
)
def submission(t: Tables):
    records = _panel_records(t)
    table, ranks = panel.build_panel(records, PANEL_ROLES)
    split = panel.split_panel(table, PANEL_ROLES, TARGET_PERIOD // 100 - BASE_YEAR, TARGET_PERIOD % 100)
    models = {"linear": sgd_linear(["sum_p_size"], split.label, "l2", 0.0)}
    predictions = panel.fit_predict(split, models)
    asked = records.filter(F.col("sale_date") == TARGET_PERIOD).select("class_id").distinct()
    requests = asked.withColumn("predict_date", F.lit(TARGET_PERIOD))
    out = panel.submission(predictions, ranks, requests, "linear")
    return rounded(out, 4, "predict_quantity")


# ------------------------------------------------------------------------- whole forecasts


@query("panel_forecast")
def panel_forecast(t: Tables):
    """Averaged, stacked, boosted and blended forecast of one month for every class.

    Two categories and two measures, small tree counts and three folds keep the query short.
    """
    table, ranks = panel.build_panel(panel.gather_records(sales(t), None, FORECAST_ROLES), FORECAST_ROLES)
    split = panel.split_panel(table, FORECAST_ROLES, TARGET_PERIOD // 100 - BASE_YEAR, TARGET_PERIOD % 100)
    train = rk.shuffled_folds(split.train, panel.CELL, 3, seed=156)
    x, y = split.features, split.label
    ridge = PolynomialRidge(inputCols=x, labelCol=y, alpha=0.6, degree=1, coef0=2.5)
    bases = [elastic_net(x, y, 0.001, 0.5), gradient_boosting(x, y, trees=5), ridge]
    stack = StackingRegressor(folds=3).of(bases, lambda names: lasso(names, y, 0.00001))
    models = {
        "average": AveragingRegressor([*bases, lasso(x, y, 0.00001)]),
        "stack": stack,
        "regularised": regularised_boosting(x, y, trees=5, rate=0.3),
        "histogram": histogram_boosting(x, y, trees=5),
    }
    folded = panel.PanelSplit(train, split.predict, split.features, split.label)
    predictions = panel.fit_predict(folded, models)
    weights = dict(zip(["stack", "regularised", "histogram"], presets.BLEND_WEIGHTS, strict=True))
    return blend(predictions, weights, "predict_quantity").join(ranks, on="class_trans").select(
        "class_id", "class_trans", *models, "predict_quantity"
    )


@query("house_forecast")
def house_forecast(t: Tables):
    """Price per unseen listing: log target, average, stack, boosters, blend, back to prices.

    Every numeric feature is used, the one-hots too. Tree counts are small to keep the query short.
    """
    features = pin(_house_features(t), "houses")
    features = rk.shuffled_folds(features, ["id"], 3, seed=156)
    train, test = listings.train_and_test(features, HOUSE_ROLES)
    y = "price"
    x = [c for c in numeric_columns(train) if c not in ("id", "fold", y, *HOUSE_ROLES.extra_keys)]
    bases = [
        elastic_net(x, y, 0.0005, 0.9),
        gradient_boosting(x, y, trees=5, loss="absolute"),
        PolynomialRidge(inputCols=x, labelCol=y, alpha=0.6, degree=1, coef0=2.5),
    ]
    members = {
        "average": AveragingRegressor([*bases, lasso(x, y, 0.0005)]),
        "stack": StackingRegressor(folds=3).of(bases, lambda names: lasso(names, y, 0.0005)),
        "regularised": regularised_boosting(x, y, trees=5, rate=0.3, feature_share=0.4603),
        "histogram": histogram_boosting(x, y, trees=5, feature_share=0.2319),
    }
    scored = test
    with kept(train) as rows:
        for name, member in members.items():
            scored = predict(member.fit(rows), scored, name)
    weights = dict(zip(["stack", "regularised", "histogram"], presets.BLEND_WEIGHTS, strict=True))
    blended = blend(scored, weights, "p")
    return blended.select(
        "id", *[F.expm1(m).alias(m) for m in members], F.expm1("p").alias("price")
    )


@query(
    "period_threshold_pushdown",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders "
    "WHERE o_orderdate > TIMESTAMP '2000-01-01' GROUP BY o_orderstatus",
)
def period_threshold_pushdown(t: Tables):
    recent = after(t.orders, "o_orderdate", "2000-01-01 00:00:00")
    return recent.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price")
    )
