"""Per-entity features from dated records."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog.aggregations import rounded, rounded_by
from panelforge.catalog.registry import query
from panelforge.catalog.views import FEE_SQL, VISITS_SQL, fee_lines, visits
from panelforge.operators import entity as ent
from panelforge.sources import Tables

_MEASURES = ("drug", "claimed", "exam")
_STATS = {
    "std": "stddev_samp({c}::DOUBLE)",
    "mean": "CAST(sum({c}) AS DOUBLE) / count({c})",
    "max": "max({c}::DOUBLE)",
    "median": "median({c}::DOUBLE)",
}
_DIGITS = {"std": 4, "mean": 6, "max": 6, "median": 6}


def _two_level_sql(cte: str, bucket: str, sums: dict[str, str], stats: dict, pattern: str, cells=""):
    inner = ", ".join(f"coalesce(sum({e}), 0) AS {c}" for c, e in sums.items())
    outer = ", ".join(
        f"round({fn.format(c=c)}, {_DIGITS[s]}) AS " + pattern.format(column=c, stat=s)
        for c in sums
        for s, fn in stats.items()
    )
    extra = f", count(*) AS {cells}" if cells else ""
    return (
        f"WITH {cte}, cells AS (SELECT person, {bucket} AS bucket, {inner} FROM {cte.split()[0]} "
        f"GROUP BY person, {bucket}) SELECT person, {outer}{extra} FROM cells GROUP BY person"
    )


_FLAT_VISITS = VISITS_SQL.strip()
_FLAT_FEE = FEE_SQL.strip()


def _rounded_stats(df, columns, stats, pattern):
    return rounded_by(
        df, {pattern.format(column=c, stat=s): _DIGITS[s] for c in columns for s in stats}
    )


@query(
    "a13_daily_statistics",
    _two_level_sql(
        _FLAT_VISITS, "day", {c: c for c in _MEASURES}, _STATS, "{column}_{stat}_byday"
    ),
)
def daily_statistics(t: Tables):
    stats = ent.bucket_statistics(visits(t, text=False), "person", "day", _MEASURES)
    return _rounded_stats(stats, _MEASURES, _STATS, "{column}_{stat}_byday")


@query(
    "a14_active_days",
    "SELECT o_custkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS day_records_num FROM orders "
    "GROUP BY o_custkey",
)
def active_days(t: Tables):
    orders = t.orders.withColumn("day", F.to_date("o_orderdate"))
    days = ent.distinct_days(orders, "o_custkey", "day")
    return ent.record_counts(days, "o_custkey", "day_records_num")


@query(
    "a15_monthly_statistics",
    _two_level_sql(
        _FLAT_VISITS,
        "month",
        {c: c for c in _MEASURES},
        _STATS,
        "{column}_{stat}_bymonth",
        "month_records_num",
    ),
)
def monthly_statistics(t: Tables):
    pattern = "{column}_{stat}_bymonth"
    stats = ent.bucket_statistics(
        visits(t, text=False), "person", "month", _MEASURES, pattern=pattern, cells_name="month_records_num"
    )
    return _rounded_stats(stats, _MEASURES, _STATS, pattern)


_MARKS = {
    "special": "CASE WHEN contains(text, 'small') THEN 1 ELSE 0 END",
    "registration": "CASE WHEN contains(text, 'promo') AND NOT contains(text, 'small') "
    "THEN 1 ELSE 0 END",
}


def _mark_sql(bucket: str, suffix: str) -> str:
    present = (
        _FLAT_VISITS
        + ", noted AS (SELECT * FROM visits WHERE text IS NOT NULL)"
    )
    sql = _two_level_sql(present, bucket, _MARKS, _STATS, "{column}_{stat}_" + suffix)
    return sql.replace("FROM visits GROUP BY", "FROM noted GROUP BY")


@query("a16_keyword_days", _mark_sql("day", "byday"))
def keyword_days(t: Tables):
    stats = ent.flag_statistics(visits(t), "person", "day", "text", "small", "promo", "byday")
    return _rounded_stats(stats, _MARKS, _STATS, "{column}_{stat}_byday")


@query("a17_keyword_months", _mark_sql("month", "bymonth"))
def keyword_months(t: Tables):
    stats = ent.flag_statistics(visits(t), "person", "month", "text", "small", "promo", "bymonth")
    return _rounded_stats(stats, _MARKS, _STATS, "{column}_{stat}_bymonth")


@query(
    "a18_venues_per_day",
    "WITH "
    + FEE_SQL
    + "SELECT person, max(n) AS hospitals_perday_max, CAST(median(n) AS DOUBLE) "
    "AS hospitals_perday_median FROM (SELECT person, day, count(DISTINCT venue) AS n FROM fee "
    "GROUP BY person, day) GROUP BY person",
)
def venues_per_day(t: Tables):
    return ent.venue_statistics(
        fee_lines(t), "person", "day", "venue", ["max", "median"], "hospitals_perday"
    )


@query(
    "a19_venues_per_month",
    "WITH "
    + FEE_SQL
    + "SELECT person, max(n) AS hospitals_permonth_max, round(avg(n), 6) AS hospitals_permonth_mean, "
    "round(stddev_samp(n), 6) AS hospitals_permonth_std FROM (SELECT person, month(day) AS m, "
    "count(DISTINCT venue) AS n FROM fee GROUP BY person, m) GROUP BY person",
)
def venues_per_month(t: Tables):
    lines = fee_lines(t).withColumn("month", F.month("day"))
    stats = ent.venue_statistics(
        lines, "person", "month", "venue", ["max", "mean", "std"], "hospitals_permonth"
    )
    return rounded(stats, 6, "hospitals_permonth_mean", "hospitals_permonth_std")


_FEE_SUMS = {
    "drug_fee": "unit_price * quantity",
    "drug_counts": "quantity",
}


def _fee_columns():
    return {
        "drug_fee": F.col("unit_price") * F.col("quantity"),
        "drug_counts": F.col("quantity"),
    }


_THREE = {s: _STATS[s] for s in ("max", "mean", "std")}


@query(
    "a20_amounts_per_day",
    _two_level_sql(_FLAT_FEE, "day", _FEE_SUMS, _THREE, "{column}_perday_{stat}"),
)
def amounts_per_day(t: Tables):
    pattern = "{column}_perday_{stat}"
    stats = ent.bucket_statistics(
        fee_lines(t), "person", "day", _fee_columns(), list(_THREE), pattern
    )
    return _rounded_stats(stats, _FEE_SUMS, _THREE, pattern)


@query(
    "a21_amounts_per_month",
    _two_level_sql(_FLAT_FEE, "month(day)", _FEE_SUMS, _THREE, "{column}_permonth_{stat}"),
)
def amounts_per_month(t: Tables):
    pattern = "{column}_permonth_{stat}"
    lines = fee_lines(t).withColumn("month", F.month("day"))
    stats = ent.bucket_statistics(lines, "person", "month", _fee_columns(), list(_THREE), pattern)
    return _rounded_stats(stats, _FEE_SUMS, _THREE, pattern)


@query(
    "a22_item_codes_per_day",
    _two_level_sql(_FLAT_FEE, "day", {"cata3": "item_code"}, _THREE, "{column}_perday_{stat}"),
)
def item_codes_per_day(t: Tables):
    pattern = "{column}_perday_{stat}"
    codes = {"cata3": F.col("item_code")}
    stats = ent.bucket_statistics(fee_lines(t), "person", "day", codes, list(_THREE), pattern)
    return _rounded_stats(stats, codes, _THREE, pattern)


@query(
    "a22_item_codes_per_month",
    _two_level_sql(
        _FLAT_FEE, "month(day)", {"cata3": "item_code"}, _THREE, "{column}_permonth_{stat}"
    ),
)
def item_codes_per_month(t: Tables):
    pattern = "{column}_permonth_{stat}"
    codes = {"cata3": F.col("item_code")}
    lines = fee_lines(t).withColumn("month", F.month("day"))
    stats = ent.bucket_statistics(lines, "person", "month", codes, list(_THREE), pattern)
    return _rounded_stats(stats, codes, _THREE, pattern)


@query(
    "a23_day_correlation",
    "WITH "
    + FEE_SQL
    + ", cells AS (SELECT person, day, sum(quantity)::DOUBLE AS q, "
    "sum(unit_price * quantity)::DOUBLE AS a, "
    "date_diff('day', DATE '1970-01-01', day)::DOUBLE AS d FROM fee GROUP BY person, day) "
    "SELECT person, "
    + ", ".join(
        f"CASE WHEN stddev_samp({c}) > 0 AND stddev_samp(d) > 0 THEN "
        f"round(covar_samp({c}, d) / (stddev_samp({c}) * stddev_samp(d)), 6) END AS {n}_corrwithday"
        for n, c in (("quantity", "q"), ("amount", "a"))
    )
    + " FROM cells GROUP BY person",
)
def day_correlation(t: Tables):
    measures = {
        "quantity": F.col("quantity"),
        "amount": F.col("unit_price") * F.col("quantity"),
    }
    stats = ent.day_correlation(fee_lines(t), "person", "day", measures)
    return rounded(stats, 6, "quantity_corrwithday", "amount_corrwithday")


@query(
    "a31_repeat_rate",
    "WITH "
    + FEE_SQL
    + "SELECT person, count(form) AS med_kinds_total, count(DISTINCT form) AS med_kinds_nunique, "
    "round((count(form) - count(DISTINCT form)) / count(form), 6) AS med_kinds_rep_rate FROM fee "
    "WHERE form IS NOT NULL GROUP BY person",
)
def repeat_rate(t: Tables):
    rates = ent.repeat_rate(fee_lines(t), "person", "form", "med_kinds")
    return rounded(rates, 6, "med_kinds_rep_rate")


@query(
    "x11_pieces_per_person",
    "WITH "
    + VISITS_SQL
    + "SELECT person, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE "
    "len(regexp_split_to_array(text, '\\W+')) END) AS BIGINT) AS diseases_kinds FROM visits "
    "GROUP BY person",
)
def pieces_per_person(t: Tables):
    return ent.diagnosis_pieces(visits(t), "person", "text", "diseases_kinds")


@query(
    "a13_daily_event_statistics",
    "WITH cells AS (SELECT user_id, CAST(ts AS DATE) AS day, "
    "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY ALL) "
    "SELECT user_id, round(stddev_samp(value), 4) AS value_std_byday, "
    "round(avg(value), 6) AS value_mean_byday, max(value) AS value_max_byday, "
    "round(median(value), 6) AS value_median_byday, count(*) AS day_records_num FROM cells "
    "GROUP BY user_id",
)
def daily_event_statistics(t: Tables):
    events = t.events.select(
        "user_id", F.to_date("ts").alias("day"), F.col("value").cast("decimal(18,2)").alias("value")
    )
    stats = ent.bucket_statistics(
        events, "user_id", "day", ["value"], cells_name="day_records_num"
    )
    return _rounded_stats(stats, ["value"], _STATS, "{column}_{stat}_byday")
