import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import ratios, recode
from panelforge.functions import scalars as sc
from panelforge.plans import presets


def values(spark, items, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize(
    ("items", "tokens", "kind", "expected"),
    [
        (["-", "3"], presets.LEVEL_TOKENS, "int", [6, 3]),
        (["-", "2", None], presets.FUEL_TOKENS, "int", [1, 2, None]),
        (["81/70", "91.6"], presets.POWER_TOKENS, "double", [81.0, 91.6]),
        (["155/140", "-", "230"], presets.TORQUE_TOKENS, "double", [155.0, 73.0, 230.0]),
        (["4-5", "6-7", "7-8", "5"], presets.PASSENGER_TOKENS, "int", [5, 7, 8, 5]),
        (["8;7", "6", "6月7日"], presets.GEAR_TOKENS, "int", [7, 6, None]),
        (["MT;AT", "CVT", "AT;DCT"], presets.GEARBOX_TOKENS, "string", ["MT", "CVT", "AT"]),
    ],
)
def test_token_replacement(spark, items, tokens, kind, expected):
    assert values(spark, items, recode.replace_tokens("v", tokens, kind)) == expected


def test_ordinal_and_flag(spark):
    codes = recode.ordinal("v", presets.PRICE_LEVEL_CODES)
    assert values(spark, ["5WL", "8-10W", "zzz"], codes) == [1, 3, None]
    assert values(spark, ["L", "T", None], recode.flag("v", "L")) == [1, 0, 0]


def test_periods(spark):
    assert values(spark, [201709], sc.year_offset("v", 2011), "int") == [6]
    assert values(spark, [201709, 201112], sc.period_month("v"), "int") == [9, 12]
    parsed = values(spark, ["201712", "nope", "201713", None], sc.parse_period("v"))
    assert parsed == [datetime.date(2017, 12, 1), None, None, None]
    assert values(spark, ["2015-6-07", "x"], sc.parse_day("v")) == [datetime.date(2015, 6, 7), None]
    assert values(spark, ["2015/6/7"], sc.parse_day("v", "/")) == [datetime.date(2015, 6, 7)]


def test_band_bounds(spark):
    bounds = sc.band_bounds("v")
    both = F.array(bounds["low"], bounds["high"], bounds["center"])
    assert values(spark, ["10-15W", "8-10W", "5WL"], both) == [
        [10.0, 15.0, 12.5],
        [8.0, 10.0, 9.0],
        [5.0, 5.0, 5.0],
    ]
    assert values(spark, ["none", None], bounds["low"]) == [None, None]


def test_piece_count(spark):
    assert values(spark, ["感冒, 发烧", "(a)", "", None, "one"], sc.piece_count("v")) == [2, 3, 0, 0, 1]


def test_mentions(spark):
    special = sc.mentions("v", presets.CLAIMS_SPECIAL)
    registration = sc.mentions("v", presets.CLAIMS_REGISTRATION, presets.CLAIMS_SPECIAL)
    both = F.array(special, registration)
    assert values(spark, ["门特挂号", "挂号", "感冒"], both) == [
        [True, False],
        [False, True],
        [False, False],
    ]


def test_boxcox(spark):
    out = values(spark, [0.0, 1.0, 3.0], sc.boxcox1p("v", 0.15), "double")
    assert out == pytest.approx([0.0, 0.730463, 1.540962], abs=1e-6)
    assert values(spark, [1.0], sc.boxcox1p("v", 0), "double") == pytest.approx([math.log(2)])


def test_safe_ratio_and_share(spark):
    pairs = [(3.0, 4.0), (3.0, 0.0), (-3.0, 0.0), (0.0, 0.0), (None, 2.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, n double, d double")
    out = df.orderBy("i").select(ratios.safe_ratio("n", "d"), ratios.share("n", "d")).collect()
    assert [r[0] for r in out] == [0.75, 2.0, 2.0, 0.0, 0.0]
    assert [r[1] for r in out] == [0.75, 0.0, 0.0, 0.0, 0.0]


def test_infinity(spark):
    inf = float("inf")
    assert values(spark, [inf, -inf, 1.0], sc.replace_infinite("v", 2), "double") == [2.0, 2.0, 1.0]
