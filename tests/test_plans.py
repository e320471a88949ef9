"""The three workloads end to end on tiny files with their real column names."""

import datetime
import itertools
import re
import statistics

import pytest
from pyspark.sql import functions as F

from panelforge.catalog.views import billed, charged, fee_lines, visits
from panelforge.models import sgd_linear
from panelforge.models.ensemble import predict
from panelforge.operators.entity import venue_risk
from panelforge.plans import claims, listings, panel, presets
from panelforge.sources import Tables, read_csv, read_csv_named, read_csv_stray_header, write_csv


def test_csv_byte_order_mark_and_stray_header(spark, tmp_path, rows):
    marked = tmp_path / "marked.csv"
    marked.write_text("﻿predict_date,class_id\n201711,5\n", encoding="utf-8")
    df = read_csv(spark, str(marked))
    assert df.columns == ["predict_date", "class_id"]
    stray = tmp_path / "stray.csv"
    stray.write_text("201711,5,1.5\n201711,6,2.5\npredict_date,class_id,predict_quantity\n")
    ddl = "predict_date int, class_id bigint, predict_quantity double"
    assert rows(read_csv_stray_header(spark, str(stray), ddl)) == [(201711, 5, 1.5), (201711, 6, 2.5)]
    bare = tmp_path / "bare.csv"
    bare.write_text("p1,1\np2,0\n")
    named = read_csv_named(spark, str(bare), ["person", "label"], ["string", "int"])
    assert rows(named) == [("p1", 1), ("p2", 0)]
    out = str(tmp_path / "out")
    write_csv(named, out, key="label")
    assert spark.read.option("header", True).csv(out).columns == ["label", "person"]


def vehicle_rows(spark):
    names = ["sale_date", "class_id", "sale_quantity", "price_level", *presets.VEHICLE_CATEGORIES, *presets.VEHICLE_MEASURES]
    data = []
    for n, (period, cls) in enumerate(itertools.product([201607, 201608, 201710, 201711], [11, 22, 33])):
        values = dict.fromkeys(names, "1")
        values |= {
            "sale_date": str(period),
            "class_id": str(cls),
            "sale_quantity": None if period == 201711 else str(cls * (n + 1)),
            "price_level": "5WL" if cls == 11 else "10-15W",
            "level_id": "-" if cls == 22 else "3",
            "engine_torque": "155/140",
            "rated_passenger": "5-7",
            "gearbox_type": "AT;DCT" if cls == 33 else "MT",
            "TR": "8;7",
            "car_length": "1000", "car_width": "1000", "car_height": "2",
        }
        data.append(tuple(values[c] for c in names))
    df = spark.createDataFrame(data, ", ".join(f"`{c}` string" for c in names))
    numbers = ["sale_date", "class_id", "sale_quantity", "compartment", "car_length", "car_width", "car_height"]
    df = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    return df.withColumns({c: F.col(c).cast("int") for c in ("sale_date", "class_id")})


def test_vehicle_panel_and_submission(spark, rows):
    raw = vehicle_rows(spark)
    requests = raw.filter("sale_date = 201711").withColumnsRenamed(
        {"sale_date": "predict_date", "sale_quantity": "predict_quantity"}
    )
    sold = raw.filter("sale_date <> 201711")
    roles = panel.PanelRoles(first_period=201607)
    records = panel.vehicle_records(
        panel.gather_records(sold, requests, roles, {"predict_date": "sale_date", "predict_quantity": "sale_quantity"})
    )
    roles = panel.vehicle_roles(records)
    table, ranks = panel.build_panel(records, roles)
    assert rows(ranks) == [(11, 1), (22, 2), (33, 3)]
    row = table.filter("class_trans = 2 AND year_delta = 5 AND month = 8").first()
    assert row["mean_level_id_6"] == 1 and row["mean_gearbox_type_MT"] == 1
    assert row["mean_price_level_center"] == 12.5 and row["mean_car_volume"] == 2.0
    assert row["std_engine_torque"] == 0.0 and row["mean_engine_torque"] == 155.0
    assert table.count() == 9  # July 2016 is too old
    split = panel.split_panel(table, roles, 6, 11)
    assert split.predict.count() == 3 and split.label == "sum_sale_quantity"
    assert not [c for c in split.features if "sale_quantity" in c]
    assert "record_num" in split.features
    predictions = panel.fit_predict(split, {"m": sgd_linear(["class_trans"], split.label, "l2", 0.0)})
    out = panel.submission(predictions, ranks, requests, "m")
    assert out.columns == ["predict_date", "class_id", "predict_quantity"]
    assert [r[:2] for r in rows(out)] == [(201711, 11), (201711, 22), (201711, 33)]


AMOUNTS = sorted(
    {
        *presets.CLAIMS_TOTAL_OF,
        *presets.CLAIMS_CELL_MEASURES,
        *[c for pair in presets.CLAIMS_RATIOS.values() for c in pair],
        presets.CLAIMS_ACCOUNT,
    }
)


def medical_transactions(spark, people):
    edges = [c for pair in presets.CLAIMS_DROP_RANGES for c in pair]
    names = [presets.CLAIMS_VISIT, presets.CLAIMS_PERSON, presets.CLAIMS_VENUE, presets.CLAIMS_DAY,
             presets.CLAIMS_TEXT, *AMOUNTS, *edges, *presets.CLAIMS_DROP_COLUMNS]
    data = []
    for n, (person, venue, when, text) in enumerate(people):
        amounts = [float(n + 1)] * len(AMOUNTS)
        data.append((f"{person}-{n}", person, venue, when, text, *amounts, *[9.0] * (len(edges) + 4)))
    types = ["string"] * 5 + ["double"] * (len(names) - 5)
    return spark.createDataFrame(data, ", ".join(f"`{c}` {t}" for c, t in zip(names, types, strict=True)))


def test_medical_claims(spark):
    train = medical_transactions(
        spark,
        [
            ("p1", "h1", "2015/1/1", "门特挂号"),
            ("p1", "h2", "2015/1/03", "挂号, 感冒"),
            ("p1", "h2", "2015/1/03", None),
            ("p2", "h3", "2015/2/1", None),
        ],
    )
    test = medical_transactions(spark, [("p9", "h2", "2015/3/1", "感冒")])
    labels = spark.createDataFrame([("p1", 1), ("p2", 0)], f"`{presets.CLAIMS_PERSON}` string, label int")
    fee = spark.createDataFrame(
        [
            ("p1-0", "2015-01-01", 2.0, 3.0, 7.0, "片", "h1"),
            ("p1-1", "2015-01-03", 2.0, 5.0, 7.0, "片", "h2"),
            ("p2-3", "2015-02-01", 1.0, 1.0, 7.0, None, "h3"),
            ("p9-0", "bad", 1.0, 1.0, 7.0, "丸", "h2"),
        ],
        f"`{presets.CLAIMS_VISIT}` string, `{presets.FEE_DAY}` string, `{presets.FEE_PRICE}` double, "
        f"`{presets.FEE_QUANTITY}` double, `{presets.FEE_CODE}` double, `{presets.FEE_FORM}` string, "
        f"`{presets.CLAIMS_VENUE}` string",
    )
    train_table, test_table = claims.medical_features(train, test, labels, fee)
    p1 = train_table.filter(F.col(presets.CLAIMS_PERSON) == "p1").first()
    amount = "药品费发生金额"
    assert p1[f"{amount}_sum"] == 6.0 and p1[f"{amount}_max_byday"] == 5.0
    assert p1[presets.CLAIMS_GAP_MEAN] == 2.0 and p1[presets.CLAIMS_GAP_STD] == 0.0
    assert (p1["day_records_num"], p1["month_records_num"], p1["records_num"]) == (2, 1, 3)
    assert (p1["hospital_kinds"], p1["hospital_cheat_kinds"], p1["hospital_cheat_weights"]) == (2, 2, 2)
    assert p1["diseases_kinds"] == 3
    assert (p1["special_max_byday"], p1["registration_mean_byday"]) == (1, 0.5)
    assert p1["药品费申报比例"] == 1.0 and p1[presets.CLAIMS_TOTAL] == 36.0
    assert p1["drug_fee_perday_max"] == 10.0 and p1["med_kinds_rep_rate"] == 0.5
    assert p1["label"] == 1
    p2 = train_table.filter(F.col(presets.CLAIMS_PERSON) == "p2").first()
    assert p2[presets.CLAIMS_GAP_MEAN] == -1.0 and p2["special_max_byday"] == 0
    assert p2[f"{amount}_std"] == 0.0 and p2["hospital_cheat_kinds"] == 0
    # the only fee line of the test person has no valid date, so the inner join drops it
    assert test_table.count() == 0 and "label" not in test_table.columns


def test_visit_features_survive_a_dominant_person(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(n % 50) for n in range(20_000)]
    people = [("big" if n % 3 else f"p{n}", f"h{n % 7}", d, "x", n % 10) for n, d in enumerate(days)]
    df = spark.createDataFrame(people, "person string, venue string, day date, text string, v int")
    roles = claims.VisitRoles("person", "venue", "day", "text", "s", "r", ["v"], ["v"])
    labels = spark.createDataFrame([("big", 1)], "person string, label int")
    risk = venue_risk(df, labels, "person", "venue", "label")
    row = claims.visit_features(df, risk, roles).filter("person = 'big'").first()
    mine = [p for p in people if p[0] == "big"]
    assert row["records_num"] == len(mine) and row["v_sum"] == sum(p[4] for p in mine)
    assert row["day_records_num"] == 50 and row["hospital_cheat_records"] == len(mine)
    assert row["gap_mean"] == 1.0 and row["gap_std"] == 0.0


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_fee_lines_are_shuffled_once_per_key(spark):
    day = datetime.date(2023, 1, 30)
    lines = []
    for n in range(3000):
        person, venue = ("big" if n % 3 else f"p{n % 5}"), (None if n % 11 == 0 else n * n % 7)
        when = None if n % 101 == 0 else day + datetime.timedelta(n * 37 % 800)
        lines.append((person, venue, when, n % 13, n % 4, n % 5, None if n % 2 else f"f{n % 6}"))
    columns = ["person", "venue", "day", "price", "quantity", "code", "form"]
    df = spark.createDataFrame(lines, "person string, venue int, day date, price long, quantity long, code long, form string")
    table = claims.fee_features(df, claims.FeeRoles(*columns))
    # lines, days and persons; forms and their persons
    assert _exchanges(table) <= 5
    found = {r["person"]: r for r in table.collect()}
    assert len(found) == 6
    for person, row in found.items():
        for per, bucket in (("perday", lambda d: d), ("permonth", lambda d: d.month)):
            venues, fees = {}, {}
            for p, venue, when, price, quantity, *_ in lines:
                if p == person and when:
                    venues.setdefault(bucket(when), set()).update([] if venue is None else [venue])
                    fees[bucket(when)] = fees.get(bucket(when), 0) + price * quantity
            kinds = [len(v) for v in venues.values()]
            assert row[f"hospitals_{per}_max"] == max(kinds)
            assert row[f"drug_fee_{per}_max"] == max(fees.values())
            assert row[f"drug_fee_{per}_mean"] == pytest.approx(sum(fees.values()) / len(fees))
            assert row[f"drug_fee_{per}_std"] == pytest.approx(statistics.stdev(fees.values()))
            if per == "perday":
                assert row["hospitals_perday_median"] == statistics.median(kinds)
            else:
                assert row["hospitals_permonth_mean"] == pytest.approx(sum(kinds) / len(kinds))


def test_fee_lines_of_a_person_are_shuffled_once(spark, monkeypatch, rows):
    day = datetime.date(2023, 1, 30)
    lines = []
    for n in range(2000):
        person, venue = (None if n % 97 == 0 else "big" if n % 3 else f"p{n % 5}"), (None if n % 11 == 0 else n * n % 7)
        when = None if n % 101 == 0 else day + datetime.timedelta(n * 37 % 800)
        lines.append((person, venue, when, n % 13, n % 4, n % 5, f"f{n % 6}"))
    roles = claims.FeeRoles("person", "venue", "day", "price", "quantity", "code", "form")
    df = spark.createDataFrame(lines, "person string, venue int, day date, price long, quantity long, code long, form string")
    table = claims.fee_features(df, roles)
    # the lines of a person and the forms, by key and by person
    assert _exchanges(table) == 3
    # a person of many lines is dealt by month and venue first, with the same result
    monkeypatch.setattr(claims, "BUSY_LINES", 500)
    assert [r["_busy"] for r in claims.busy_persons(df, roles).collect()] == ["big"]
    busy = claims.fee_features(df, roles)
    assert re.search(r"RepartitionByExpression \[person#\d+, _month#", busy._jdf.queryExecution().optimizedPlan().toString())
    assert rows(busy.select([F.round(c, 6) if t == "double" else c for c, t in busy.dtypes])) == rows(
        table.select([F.round(c, 6) if t == "double" else c for c, t in table.dtypes])
    )


def test_texts_that_go_are_not_shuffled_to_orders(spark):
    for fees in (False, True):
        lines = visits(Tables(spark, "/root/testdata/sf0.001"), fees=fees)
        above = lines._jdf.queryExecution().optimizedPlan().toString().split("(l_orderkey", 1)
        assert "concat_ws" not in above[0] and "concat_ws" in above[1]


def test_months_of_visits_reuse_the_days_of_a_person(spark):
    data = [(p, "h", datetime.date(2024, 1, 1) + datetime.timedelta(n), "x", n) for p in "ab" for n in range(90)]
    df = spark.createDataFrame(data, "person string, venue string, day date, text string, v int")
    roles = claims.VisitRoles("person", "venue", "day", "text", "s", "r", ["v"], ["v"])
    cells = claims.day_cells(df, roles)
    assert _exchanges(claims.day_block(cells, roles)) == 2
    months = claims.month_block(cells, roles)
    assert _exchanges(months) == 2
    assert {r["v_max_bymonth"] for r in months.collect()} == {sum(range(60, 90))}


def test_orders_are_joined_last_so_that_their_lines_meet(spark):
    plan = visits(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner, (l_orderkey") < plan.index("Join Inner, (l_partkey")


def test_visits_and_fees_share_their_lines(spark, tmp_path, rows):
    folder = "/root/testdata/sf0.001"
    for name in ("orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{folder}/{name}.parquet")
    # some lines lose their part: they are fees, but not visits
    spark.read.parquet(f"{folder}/part.parquet").filter("p_partkey % 3 <> 0").write.parquet(str(tmp_path / "part.parquet"))
    t = Tables(spark, str(tmp_path))
    lines = visits(t, fees=True)
    assert rows(billed(lines)) == rows(visits(t)) and billed(lines).columns == visits(t).columns
    columns = fee_lines(t).columns
    assert rows(charged(lines), *columns) == rows(fee_lines(t), *columns)
    assert billed(lines).count() < charged(lines).count()


def test_house_listings(spark):
    filled = [*presets.HOUSE_NONE, *presets.HOUSE_ZERO, *presets.HOUSE_MODE, "Functional", "LotFrontage"]
    numeric = [*presets.HOUSE_ZERO, "LotFrontage", "1stFlrSF", "2ndFlrSF", "GrLivArea", "OverallCond", "YrSold", "MoSold"]
    names = ["Id", "SalePrice", "Neighborhood", "Utilities", *dict.fromkeys([*filled, *presets.HOUSE_CODED, *numeric])]
    data = []
    for i in range(1, 13):
        row = {c: (float(i) if c in numeric else ["A", "B"][i % 2]) for c in names}
        row |= {"Id": i, "SalePrice": 1000.0 * i, "Neighborhood": "n", "Utilities": "x", "GrLivArea": 5000.0 if i == 3 else 90.0}
        if i == 2:
            row |= dict.fromkeys(filled)
        data.append(tuple(row[c] for c in names))
    kinds = {c: "double" for c in [*numeric, "SalePrice"]} | {"Id": "int"}
    df = spark.createDataFrame(data, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in names))
    train, test = df.filter("Id <= 8"), df.filter("Id > 8")
    table = listings.listing_features(train, test, listings.HOUSES, listings.house_outlier())
    assert table.count() == 11  # the outlier is gone
    assert "Utilities" not in table.columns and "TotalSF" in table.columns
    second = table.filter("Id = 2").first()
    assert second["SaleType_A"] + second["SaleType_B"] == 1
    assert second["GarageType_None"] == 1 and second["GarageArea"] == 0.0
    assert second["SalePrice"] == pytest.approx(7.601402)
    a, b = listings.train_and_test(table, listings.HOUSES)
    assert a.count() == 7 and b.count() == 4 and "SalePrice" not in b.columns
    scored = predict(sgd_linear(["TotalSF"], "SalePrice", "l2", 0.0).fit(a), b, "p")
    out = listings.prices(scored, "Id", "p", "SalePrice")
    assert out.filter("SalePrice > 0").count() == 4
