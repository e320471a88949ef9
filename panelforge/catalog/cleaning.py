"""Cleaning, recoding and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.registry import query
from panelforge.catalog.scalars import price_band
from panelforge.catalog.views import HOUSES_SQL, SALES_SQL, houses, sales
from panelforge.functions import recode
from panelforge.functions.ratios import safe_ratio
from panelforge.operators import impute
from panelforge.operators.aggregates import panel_statistics
from panelforge.plans import presets
from panelforge.sources import Tables


def dirty(choices: dict[int, str], modulus: int):
    """A token by the part size's remainder, else the size itself as text."""
    chain = None
    for rest, token in choices.items():
        hit = F.col("p_size") % modulus == rest
        chain = F.when(hit, F.lit(token)) if chain is None else chain.when(hit, F.lit(token))
    return chain.otherwise(F.col("p_size").cast("string"))


@query(
    "k1_sentinel_then_cast",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 6 ELSE p_size END AS level_id, "
    "CASE WHEN p_size % 7 = 0 THEN 1 ELSE p_size END AS fuel_type_id FROM part",
)
def sentinel_then_cast(t: Tables):
    level, fuel = dirty({0: "-"}, 5), dirty({0: "-"}, 7)
    return t.part.select(
        "p_partkey",
        recode.replace_tokens(level, presets.LEVEL_TOKENS, "int").alias("level_id"),
        recode.replace_tokens(fuel, presets.FUEL_TOKENS, "int").alias("fuel_type_id"),
    )


@query(
    "k2_composite_then_cast",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 81.0 ELSE p_size END::DOUBLE AS power, "
    "CASE WHEN p_size % 7 = 0 THEN 155 WHEN p_size % 7 = 1 THEN 73 ELSE p_size END::DOUBLE "
    "AS engine_torque FROM part",
)
def composite_then_cast(t: Tables):
    power, torque = dirty({0: "81/70"}, 5), dirty({0: "155/140", 1: "-"}, 7)
    return t.part.select(
        "p_partkey",
        recode.replace_tokens(power, presets.POWER_TOKENS, "double").alias("power"),
        recode.replace_tokens(torque, presets.TORQUE_TOKENS, "double").alias("engine_torque"),
    )


@query(
    "k3_range_to_upper",
    "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 7 WHEN 3 THEN 8 "
    "WHEN 4 THEN 8 WHEN 5 THEN 8 ELSE p_size END AS rated_passenger FROM part",
)
def range_to_upper(t: Tables):
    seats = dirty({0: "4-5", 1: "5-7", 2: "6-7", 3: "5-8", 4: "6-8", 5: "7-8"}, 8)
    clean = recode.replace_tokens(seats, presets.PASSENGER_TOKENS, "int")
    return t.part.select("p_partkey", clean.alias("rated_passenger"))


@query(
    "k4_multi_value_to_one",
    "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE p_size END AS \"TR\", "
    "CASE p_size % 3 WHEN 0 THEN 'AT' WHEN 1 THEN 'MT' ELSE 'CVT' END AS gearbox_type FROM part",
)
def multi_value_to_one(t: Tables):
    gears = dirty({0: "8;7", 1: "5;4"}, 6)
    box = dirty({0: "AT;DCT", 1: "MT;AT", 2: "CVT"}, 3)
    return t.part.select(
        "p_partkey",
        recode.replace_tokens(gears, presets.GEAR_TOKENS, "int").alias("TR"),
        recode.replace_tokens(box, presets.GEARBOX_TOKENS).alias("gearbox_type"),
    )


@query(
    "k5_ordinal_recode",
    "SELECT p_partkey, CASE p_size WHEN 5 THEN 1 WHEN 8 THEN 3 WHEN 10 THEN 4 WHEN 15 THEN 5 "
    "WHEN 20 THEN 6 END::DOUBLE AS price_code FROM part",
)
def ordinal_recode(t: Tables):
    size = F.col("p_size")
    band = (
        F.when(size == 5, F.lit("5WL"))
        .when(size == 8, F.lit("8-10W"))
        .otherwise(F.concat(size.cast("string"), F.lit("-"), (size + 5).cast("string"), F.lit("W")))
    )
    code = recode.ordinal(band, presets.PRICE_LEVEL_CODES).cast("double")
    return t.part.select("p_partkey", code.alias("price_code"))


@query(
    "k6_equality_flag",
    "SELECT d.doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS is_good FROM documents d "
    "LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def equality_flag(t: Tables):
    joined = t.documents.select("doc_id").join(t.labels, on="doc_id", how="left")
    return joined.select("doc_id", recode.flag("quality", 1).alias("is_good"))


@query(
    "k7_fill_constant",
    "WITH "
    + HOUSES_SQL
    + "SELECT id, coalesce(quality, 'None') AS quality, coalesce(area, 0) AS area FROM houses",
)
def fill_constant(t: Tables):
    return impute.fill_constant(houses(t), {"quality": "None", "area": 0.0}).select(
        "id", "quality", "area"
    )


@query(
    "k8_fill_mean",
    "WITH "
    + HOUSES_SQL
    + "SELECT id, round(coalesce(area, (SELECT avg(area) FROM houses)), 4) AS area, "
    "round(coalesce(frontage, (SELECT avg(frontage) FROM houses)), 4) AS frontage FROM houses",
)
def fill_mean(t: Tables):
    filled = impute.fill_mean(houses(t), ["area", "frontage"])
    return filled.select("id", *[F.round(c, 4).alias(c) for c in ("area", "frontage")])


_MODE = "(SELECT {c} FROM houses WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "k9_fill_mode",
    "WITH "
    + HOUSES_SQL
    + f"SELECT id, coalesce(zone, {_MODE.format(c='zone')}) AS zone, "
    f"coalesce(quality, {_MODE.format(c='quality')}) AS quality FROM houses",
)
def fill_mode(t: Tables):
    return impute.fill_mode(houses(t), ["zone", "quality"]).select("id", "zone", "quality")


@query(
    "k10_fill_group_median",
    "WITH "
    + HOUSES_SQL
    + "SELECT id, neighborhood, round(coalesce(frontage, median(frontage) OVER "
    "(PARTITION BY neighborhood)), 4) AS frontage FROM houses",
)
def fill_group_median(t: Tables):
    filled = impute.fill_group_median(houses(t), "neighborhood", ["frontage"])
    return filled.select("id", "neighborhood", F.round("frontage", 4).alias("frontage"))


@query(
    "k11_fill_undefined_deviation",
    "WITH "
    + SALES_SQL
    + "SELECT class_id, sale_date, round(coalesce(stddev_samp(sale_quantity), 0), 6) "
    "AS std_sale_quantity FROM sales GROUP BY class_id, sale_date",
)
def fill_undefined_deviation(t: Tables):
    cells = panel_statistics(sales(t), ["class_id", "sale_date"], ["sale_quantity"])
    return cells.select(
        "class_id", "sale_date", F.round("std_sale_quantity", 6).alias("std_sale_quantity")
    )


@query(
    "k12_replace_infinite_ratio",
    "SELECT l_orderkey, CASE WHEN t <> 0 THEN round(d / t, 6) WHEN d <> 0 THEN 2 ELSE 0 END "
    "AS ratio FROM (SELECT l_orderkey, round(sum(l_discount), 2) AS d, round(sum(l_tax), 2) AS t "
    "FROM lineitem GROUP BY l_orderkey)",
)
def replace_infinite_ratio(t: Tables):
    sums = t.lineitem.groupBy("l_orderkey").agg(
        F.round(F.sum("l_discount"), 2).alias("d"), F.round(F.sum("l_tax"), 2).alias("t")
    )
    return sums.select("l_orderkey", F.round(safe_ratio("d", "t"), 6).alias("ratio"))


@query(
    "k13_fill_remaining_nulls",
    "WITH "
    + HOUSES_SQL
    + "SELECT id, coalesce(area, 0) AS area, coalesce(frontage, 0) AS frontage, zone FROM houses",
)
def fill_remaining_nulls(t: Tables):
    return impute.fill_rest(houses(t).select("id", "area", "frontage", "zone"), 0)


@query(
    "k14_number_as_category",
    "SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) AS month, "
    "CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders",
)
def number_as_category(t: Tables):
    return t.orders.select(
        "o_orderkey",
        F.month("o_orderdate").cast("string").alias("month"),
        F.year("o_orderdate").cast("string").alias("year"),
    )


POLICY = impute.FillPolicy(
    constant={"quality": "None", "area": 0.0},
    mode=["zone"],
    group_median={"frontage": "neighborhood"},
    drop=["condition"],
)


@query(
    "k15_fill_policy",
    "WITH "
    + HOUSES_SQL
    + f"SELECT id, neighborhood, coalesce(zone, {_MODE.format(c='zone')}) AS zone, "
    "round(coalesce(frontage, median(frontage) OVER (PARTITION BY neighborhood)), 4) AS frontage, "
    "coalesce(area, 0) AS area, coalesce(quality, 'None') AS quality, price FROM houses",
)
def fill_policy(t: Tables):
    filled = impute.apply_policy(houses(t), POLICY)
    return filled.withColumn("frontage", F.round("frontage", 4))


@query(
    "k4_clean_vehicle_record",
    "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 6 ELSE p_size END AS level_id, "
    "CASE WHEN p_size % 5 = 0 THEN 155 WHEN p_size % 5 = 1 THEN 73 ELSE p_size END::DOUBLE "
    "AS engine_torque, CASE WHEN p_size < 5 THEN p_size ELSE p_size + 2.5 END::DOUBLE AS center "
    "FROM part",
)
def clean_vehicle_record(t: Tables):
    raw = t.part.select(
        "p_partkey",
        dirty({0: "-"}, 7).alias("level_id"),
        dirty({0: "155/140", 1: "-"}, 5).alias("engine_torque"),
        price_band().alias("price_level"),
    )
    clean = presets.clean_vehicle_columns(raw)
    bounds = presets.add_price_bounds(clean)
    return bounds.select(
        "p_partkey", "level_id", "engine_torque", F.col("price_level_center").alias("center")
    )
