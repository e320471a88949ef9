import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import aggregates as ag
from panelforge.operators import columns as cols
from panelforge.operators import encode, entity, filters, impute, joins, profile, ranking
from panelforge.operators.quantiles import exact_medians, exact_quantiles
from panelforge.sources import NULL_TOKENS, read_csv


def day(n):
    return datetime.date(2024, 1, n)


def test_mode_takes_smallest_on_ties(spark, rows):
    df = spark.createDataFrame([(2,), (1,), (1,), (2,), (None,)], "v int")
    assert rows(impute.fill_mode(df, ["v"])) == [(1,), (1,), (1,), (2,), (2,)]
    grouped = spark.createDataFrame(
        [("a", 3, "x"), ("a", 3, "y"), ("a", 4, "y"), ("b", None, "z"), ("b", None, "q")],
        "k string, n int, t string",
    )
    assert rows(ag.most_frequent(grouped, ["k"], ["n", "t"])) == [("a", 3, "y"), ("b", None, "q")]


def test_group_median_fill(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "g string, v double"
    )
    filled = rows(impute.fill_group_median(df, "g", ["v"]))
    assert filled == [("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", None)]


def test_fill_policy_applies_every_kind(spark, rows):
    df = spark.createDataFrame(
        [(1, "n", None, 4.0, None, 1), (2, "n", "RL", None, "x", 2), (3, "m", "RL", None, None, 3)],
        "id int, hood string, zone string, front double, fence string, gone int",
    )
    policy = impute.FillPolicy({"fence": "None"}, ["zone"], {"front": "hood"}, ["gone"])
    out = impute.apply_policy(df, policy)
    assert out.columns == ["id", "hood", "zone", "front", "fence"]
    assert rows(out) == [
        (1, "n", "RL", 4.0, "None"),
        (2, "n", "RL", 4.0, "x"),
        (3, "m", "RL", None, "None"),
    ]


def test_single_row_deviation_is_zero(spark, rows):
    df = spark.createDataFrame([(1, 5.0)], "k int, v double")
    cells = ag.panel_statistics(df, ["k"], ["v"], record_of="v")
    assert rows(cells) == [(1, 5.0, 5.0, 0.0, 1)]


def test_marks_have_the_statistics_of_measures(spark):
    df = spark.createDataFrame([(i % 4 if i else 9, int(i % 3 == 0)) for i in range(40)], "k int, m int")
    plain = {r["k"]: r for r in ag.panel_statistics(df, ["k"], ["m"]).collect()}
    short = {r["k"]: r for r in ag.panel_statistics(df, ["k"], [], marks=["m"]).collect()}
    assert len(short) == 5
    for k, row in plain.items():
        assert short[k].asDict() == pytest.approx(row.asDict())


def test_keep_months_includes_september(spark, rows):
    df = spark.createDataFrame([(201708,), (201709,), (201711,)], "d int")
    assert rows(filters.keep_months(df, "d")) == [(201709,), (201711,)]


def test_filters_keep_nulls_under_negation(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "k int, v int")
    match, rest = filters.split_where(df, F.col("v") > 6)
    assert rows(match, "k") == [(3,)]
    assert rows(rest, "k") == [(1,), (2,)]
    assert rows(filters.drop_where_any(df, {"v": [5]}), "k") == [(1,), (3,)]


def test_union_and_joins(spark, rows):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "a int, c int")
    union = joins.union_all([a, b])
    assert union.columns == ["a", "b", "c"]
    assert rows(union) == [(1, 2, None), (3, None, 4)]
    left = spark.createDataFrame([(1, "p")], "k int, v string")
    right = spark.createDataFrame([(1, "q")], "k int, v string")
    assert joins.suffixed(left, right, "k").columns == ["k", "v_x", "v_y"]
    table = spark.createDataFrame([(1, 7)], "k int, w int")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(joins.lookup(keys, table, "k", "w", 0)) == [(1, 7), (2, 0)]
    assert rows(joins.member_flag(keys, table, "k", "hit")) == [(1, 1), (2, 0)]


def test_column_choice(spark):
    df = spark.createDataFrame(
        [(1, 0.0, None, "a", None), (2, 0.0, None, "b", 3)],
        "id int, zero double, none int, text string, some int",
    )
    assert cols.nonzero_columns(df) == ["id", "text", "some"]
    assert cols.complete_columns(df) == ["id", "zero", "text"]
    assert cols.drop_range(df, "zero", "text").columns == ["id", "some"]
    assert cols.drop_matching(df, "o.e$").columns == ["id", "zero", "text"]
    assert cols.numeric_complete(df).columns == ["id", "zero"]


def test_rank_counts_up_from_the_smallest(spark, rows):
    df = spark.createDataFrame([("A", 10), ("B", 30), ("C", 20)], "k string, total int")
    ranked = ranking.rank_entities(df, "total", "k", "rank")
    assert rows(ranked, "k", "rank") == [("A", 1), ("B", 3), ("C", 2)]


def test_positions_over_many_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("v"))
    placed = ranking.with_position(df, [F.col("v")], "p").collect()
    assert all(r["p"] == r["v"] + 1 for r in placed) and len(placed) == 5000


@pytest.mark.parametrize(("n", "k"), [(10, 3), (11, 3), (12, 3), (2, 3)])
def test_fold_sizes_differ_by_at_most_one(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "key")
    folds = ranking.contiguous_folds(df, [F.col("key")], k).orderBy("key").collect()
    expected = [i for i, part in enumerate(np.array_split(np.arange(n), k)) for _ in part]
    assert [r["fold"] for r in folds] == expected
    shuffled = ranking.shuffled_folds(df, ["key"], k, seed=1).groupBy("fold").count().collect()
    sizes = [r["count"] for r in shuffled]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_random_splits_are_reproducible(spark, rows):
    df = spark.range(2000).withColumnRenamed("id", "key")
    a, b = (rows(ranking.random_splits(df.repartition(n), ["key"], 0.7, 2)) for n in (2, 5))
    assert a == b
    assert 0.65 < sum(r[1] for r in a) / 2000 < 0.75


def test_quantiles_match_numpy_under_skew(spark):
    rng = np.random.default_rng(5)
    n = 60_000
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n))
    value = np.where(rng.random(n) < 0.3, 7.0, rng.normal(0, 100, n))
    import pandas as pd

    pdf = pd.DataFrame({"g": group, "v": value})
    df = spark.createDataFrame(pdf)
    cuts = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    whole = exact_quantiles(df, [], ["v"], cuts).first()["v"]
    assert whole == pytest.approx(list(np.quantile(value, cuts)))
    for row in exact_quantiles(df, ["g"], ["v"], cuts).collect():
        assert row["v"] == pytest.approx(list(np.quantile(value[group == row["g"]], cuts)))
    medians = {r["g"]: r["v"] for r in exact_medians(df, ["g"], ["v"]).collect()}
    assert medians[0] == pytest.approx(np.median(value[group == 0]))


@pytest.mark.parametrize("digit", [9, 12, 40])
def test_quantiles_descend_through_every_digit(spark, monkeypatch, digit):
    from panelforge.operators import quantiles

    monkeypatch.setattr(quantiles, "DIGIT", digit)
    rng = np.random.default_rng(7)
    n = 3_000
    group = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 4, n))
    near = 1.0 + rng.integers(0, 40, n) * 2.0**-52  # values that differ in their last bits only
    wide = rng.normal(0, 1, n) * 10.0 ** rng.integers(-300, 300, n)
    rows = [(int(g), float(v), float(w), float(z)) for g, v, w, z in zip(group, near, wide, rng.normal(0, 9, n) // 4)]
    df = spark.createDataFrame(rows, "g int, v double, w double, z double").repartition(5)
    value = {c: np.array([r[i] for r in rows]) for i, c in enumerate("vwz", 1)}
    cuts = [0.0, 0.3, 0.5, 1.0]
    whole = exact_quantiles(df, [], ["v", "w", "z"], cuts).first()
    for c in "vwz":
        assert whole[c] == pytest.approx(list(np.quantile(value[c], cuts)), rel=1e-15)
    got = exact_quantiles(df, ["g"], ["v", "w", "z"], cuts).collect()
    assert len(got) == 4
    for row in got:
        for c in "vwz":
            assert row[c] == pytest.approx(list(np.quantile(value[c][group == row["g"]], cuts)), rel=1e-15)


def test_quantiles_of_null_keys_zeros_infinities_and_no_rows(spark):
    rows = [(None, None, -0.0), (None, None, 0.0), ("a", None, float("inf")), ("a", "b", float("-inf")), ("a", "b", 4.0), ("c", "d", None)]
    df = spark.createDataFrame(rows, "k string, v string, x double")
    got = {(r.k, r.v): r.x for r in exact_quantiles(df, ["k", "v"], ["x"], [0.0, 1.0]).collect()}
    inf = float("inf")
    assert got == {(None, None): [0, 0], ("a", None): [inf, inf], ("a", "b"): [-inf, 4.0], ("c", "d"): [None, None]}
    empty = df.where("k = 'q'")
    assert exact_quantiles(empty, ["k"], ["x"], [0.5]).collect() == []
    assert [r.x for r in exact_quantiles(empty, [], ["x"], [0.5]).collect()] == [[None]]


def test_quantiles_move_no_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "CAST(id AS double) AS v")
    plan = exact_quantiles(df, ["g"], ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Range" not in plan  # only written ranks are read


def test_group_statistics_do_not_shuffle_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    out = joins.attach_groups(df, df.groupBy("g").agg(F.avg("v").alias("m")), "g")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_quantiles_of_small_and_null_groups(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None), ("d", 4.0), ("d", 1.0), ("d", 9.0)],
        "g string, v double",
    )
    out = {r["g"]: r["v"] for r in exact_quantiles(df, ["g"], ["v"], [0.25, 0.5]).collect()}
    assert out["a"] == [1.0, 1.0]
    assert out["b"] == [1.25, 1.5]
    assert out["d"] == [2.5, 4.0]
    assert out.get("c", [None, None]) == [None, None]


def test_robust_scale(spark, rows):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert rows(encode.robust_scale(df, ["v"])) == sorted(
        [(-1.0,), (-0.5,), (0.0,), (0.5,), (1.0,)], key=repr
    )


def test_encodings(spark, rows):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "i int, c string")
    assert rows(encode.label_codes(df, ["c"])) == [(1, 1), (2, 0), (3, 1), (4, None)]
    hot = encode.one_hot(df)
    assert hot.columns == ["i", "c_a", "c_b"]
    assert rows(hot) == [(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 0, 0)]
    many = spark.range(200).select(((F.col("id") * 37) % 200 + 1000).alias("c"))
    coded = encode.label_codes(many.withColumn("raw", F.col("c")), ["c"])
    assert coded.filter(F.col("c") != F.col("raw") - 1000).count() == 0


def test_vocabulary_is_bounded(spark):
    with pytest.raises(ValueError, match="categories"):
        encode.vocabulary(spark.range(50), ["id"], max_categories=10)


def test_label_codes_have_no_bound(spark):
    df = spark.range(7_000).select(
        ((F.col("id") * 37) % 7_000 + 5).alias("a"), (F.col("id") % 3).cast("string").alias("b"), "id"
    )
    coded = encode.label_codes(df, ["b", "a"])
    assert coded.columns == ["a", "b", "id"]
    assert coded.filter("a <> (id * 37) % 7000 OR b <> id % 3").count() == 0
    fixed = encode.label_codes(spark.createDataFrame([("y",), ("?",), ("x",)], "c string"), ["c"], {"c": ["x", "y"]})
    assert sorted(r[0] for r in fixed.where("c IS NOT NULL").collect()) == [0, 1] and fixed.count() == 3


@pytest.mark.parametrize("constants", [2, 11])
def test_constant_columns_do_not_hide_the_others(spark, constants):
    df = spark.range(20).select(F.col("id").cast("double").alias("a"), *[F.lit(1.0).alias(f"k{i}") for i in range(constants)])
    got = {(r.col_a, r.col_b): r.r for r in profile.correlation_matrix(df).collect()}
    assert got.pop(("a", "a")) == pytest.approx(1.0)
    assert set(got.values()) == {None}


def test_text_fills_turn_numbers_into_text(spark, rows):
    df = spark.createDataFrame([(1, 20), (2, None)], "i int, n int")
    assert rows(impute.fill_constant(df, {"n": "None"})) == [(1, "20"), (2, "None")]
    policy = impute.FillPolicy(constant={"n": "None"})
    assert rows(impute.apply_policy(df, policy)) == [(1, "20"), (2, "None")]
    assert rows(impute.fill_constant(df, {"n": 0})) == [(1, 20), (2, 0)]


def test_csv_null_tokens(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("\ufeffid,frontage,alley,sub\n1,65,NA,20\n2,NA,Grvl,\n3,1.5,N/A,60\n", "utf-8")
    df = read_csv(spark, str(tmp_path / "a.csv"), null_tokens=NULL_TOKENS)
    assert dict(df.dtypes) == {"id": "int", "frontage": "double", "alley": "string", "sub": "int"}
    assert rows(df) == [(1, 65.0, None, 20), (2, None, "Grvl", None), (3, 1.5, None, 60)]
    typed = read_csv(spark, str(tmp_path / "a.csv"), "id int, frontage double, alley string, sub int", null_tokens=["NA", ""])
    assert rows(typed)[1] == (2, None, "Grvl", None)


def test_unskew_changes_only_skewed_columns(spark, rows):
    df = spark.createDataFrame([(float(i), float(i == 9) * 50) for i in range(10)], "a double, b double")
    out = encode.unskew(df, ["a", "b"])
    assert rows(out, "a") == rows(df, "a")
    assert max(r[0] for r in rows(out, "b")) < 10


def test_profiles(spark, rows):
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (4.0, 3), (9.0, None)], "a double, b int")
    skew = {r["column"]: r["skew"] for r in profile.skew_table(df).collect()}
    assert skew["a"] == pytest.approx(0.768417, abs=1e-6)
    assert rows(profile.missing_report(df)) == [("b", 25.0)]
    assert rows(profile.profile(df)) == [("a", "double", 4, 4), ("b", "int", 4, 3)]
    density = profile.density_table(df, "a", bins=4).collect()
    assert sum(r["density"] * (r["high"] - r["low"]) for r in density) == pytest.approx(1.0)
    assert sum(r["n"] for r in density) == 4


def test_correlations(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None), (2.0, 1.0, 5.0, 1.0), (4.0, 7.0, 5.0, 2.0), (5.0, 6.0, 5.0, 9.0)],
        "a double, b double, c double, d double",
    )
    r = {(x["col_a"], x["col_b"]): x["r"] for x in profile.correlation_matrix(df).collect()}
    assert len(r) == 16
    assert r["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4, 5], [2, 1, 7, 6])[0, 1])
    assert r["a", "d"] == r["d", "a"] == pytest.approx(np.corrcoef([2, 4, 5], [1, 2, 9])[0, 1])
    assert r["a", "a"] == pytest.approx(1.0)
    assert all(r[p] is None for p in r if "c" in p)


def test_wide_correlations_agree_with_pairwise(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 1, (300, 4))
    data[:, 3] = 5.0
    rows = [(*map(float, r), None if i % 3 else float(r[0] + i)) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double, gap double")

    def table():
        return {(x["col_a"], x["col_b"]): x["r"] for x in profile.correlation_matrix(df).collect()}

    pairwise = table()
    monkeypatch.setattr(profile, "_MATRIX_PAIRS", 1)
    wide = table()
    assert wide.keys() == pairwise.keys() and len(wide) == 25
    for pair, r in pairwise.items():
        assert wide[pair] == (None if r is None else pytest.approx(r))
    assert wide["flat", "flat"] is None and wide["a", "gap"] is not None


def test_normal_quantiles_are_symmetric(spark):
    df = spark.range(101).select("id", F.col("id").cast("double").alias("v"))
    table = profile.normal_quantiles(df, "v", "id").orderBy("id").collect()
    x = [r["theoretical"] for r in table]
    assert x[50] == pytest.approx(0.0, abs=1e-12)
    assert x[0] == pytest.approx(-x[100]) and x[0] == pytest.approx(-2.463, abs=5e-3)
    line = profile.normal_line(profile.normal_quantiles(df, "v", "id")).first()
    assert line["intercept"] == pytest.approx(50.0)


def test_two_level_statistics(spark):
    df = spark.createDataFrame(
        [("p", day(1), 0.5), ("p", day(1), 0.5), ("p", day(2), 2.0), ("p", day(3), 6.0)],
        "p string, d date, v double",
    )
    row = entity.bucket_statistics(df, "p", "d", ["v"], cells_name="days").first()
    assert row["v_std_byday"] == pytest.approx(2.645751, abs=1e-6)
    assert (row["v_mean_byday"], row["v_max_byday"], row["v_median_byday"]) == (3.0, 6.0, 2.0)
    assert row["days"] == 3


def test_day_correlation(spark):
    df = spark.createDataFrame(
        [("p", day(1), 1.0), ("p", day(2), 2.0), ("p", day(3), 4.0), ("q", day(1), 3.0), ("q", day(2), 3.0), ("r", day(5), 1.0)],
        "p string, d date, v double",
    )
    out = {r["p"]: r["v_corrwithday"] for r in entity.day_correlation(df, "p", "d", ["v"]).collect()}
    assert out["p"] == pytest.approx(0.981981, abs=1e-6)
    assert out["q"] is None and out["r"] is None


def test_gaps(spark, rows):
    df = spark.createDataFrame(
        [("p", day(1)), ("p", day(1)), ("p", day(3)), ("p", day(8)), ("q", day(4))],
        "p string, d date",
    )
    assert rows(entity.day_gaps(df, "p", "d"), "p", "gap") == [("p", 2), ("p", 5), ("q", -1)]
    assert rows(entity.day_gaps(df, "p", "d", 2), "p", "gap") == [("p", 3), ("q", -1)]
    assert rows(entity.gap_statistics(df, "p", "d")) == [("p", 3.5, 1.5), ("q", -1.0, 0.0)]


def test_venue_risk(spark, rows):
    records = spark.createDataFrame(
        [("p1", "h1"), ("p1", "h1"), ("p1", "h2"), ("p2", "h1"), ("p3", "h3")], "p string, h string"
    )
    labels = spark.createDataFrame([("p1", 1), ("p2", 1), ("p3", 0)], "p string, y int")
    risk = entity.venue_risk(records, labels, "p", "h", "y")
    assert rows(risk) == [("h1", 2), ("h2", 1)]
    assert rows(entity.entity_risk(records, risk, "p", "h")) == [
        ("p1", 2, 3, 3),
        ("p2", 1, 1, 2),
        ("p3", 0, 0, 0),
    ]


def test_repeat_rate(spark):
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", "y"), ("p", None)], "p string, f string")
    row = entity.repeat_rate(df, "p", "f", "kinds").first()
    assert (row["kinds_total"], row["kinds_nunique"]) == (3, 2)
    assert row["kinds_rep_rate"] == pytest.approx(1 / 3)


def test_edge_rows_and_rmse(spark, rows):
    df = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 5, "c")], "p string, o int, v string")
    assert rows(entity.first_per_entity(df, "p", ["o"])) == [("p", 1, "a"), ("q", 5, "c")]
    assert rows(entity.last_per_entity(df, "p", ["o"])) == [("p", 2, "b"), ("q", 5, "c")]
    scored = spark.createDataFrame([(1.0, 2.0), (3.0, 1.0)], "y double, p double")
    assert ag.rmse(scored, "y", "p").first()["rmse"] == pytest.approx(math.sqrt(2.5))
    logs = ag.rmsle(scored, "y", "p").first()["rmsle"]
    expected = math.sqrt((math.log(2 / 3) ** 2 + math.log(4 / 2) ** 2) / 2)
    assert logs == pytest.approx(expected)
