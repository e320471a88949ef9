from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from panelforge.llm import common
from panelforge.llm.exact_dedup import ENTRY, digests, exact_dedup, keep_distinct, merge_runs, merge_runs_of, sorted_run

BLANK = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(BLANK)].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        group = groups[(text or "").translate(BLANK)]
        best = min(group)
        out.append((doc_id, None if best[1] else best[2], len(group)))
    return sorted(out, key=repr)


ROWS = [
    (5, "a b"), (3, "ab"), (9, "a\tb"), (1, "abc"), (7, None), (8, ""), (2, " \n"), (None, "abc"),
    (4, "x y"), (6, "xy"), (10, "long " * 30_000), (11, "long" * 30_000), (12, "A b"),
]


def test_matches_brute_force_at_any_number_of_rounds(docs_of):
    docs = docs_of(ROWS + [(100 + i, f"t{i % 37}") for i in range(300)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for per_slot in (4, 100, 1000):
        got = exact_dedup(docs.repartition(5), fan=2, rows_per_slot=per_slot).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == brute(rows)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def random_entries(rng, n, kinds=40):
    entries = np.zeros(n, ENTRY)
    # digests that end in zero bytes are digests like any other
    entries["digest"] = [bytes([rng.integers(kinds), 0, rng.integers(2)]).ljust(48, b"\0") for _ in range(n)]
    entries["chars"], entries["no_id"] = rng.integers(0, 3, n), rng.integers(0, 2, n)
    entries["id"] = np.where(entries["no_id"] == 1, 0, rng.integers(-3, 3, n))
    entries["row"], entries["size"] = rng.permutation(n), 1
    return entries


def test_merged_runs_equal_one_sort():
    rng = np.random.default_rng(2)
    for parts in (1, 2, 3, 7, 16):
        entries = random_entries(rng, 400)
        runs = [sorted_run(part) for part in np.array_split(entries, parts)] + [sorted_run(entries[:0])]
        merged = merge_runs_of(runs)
        assert merged.tolist() == sorted_run(entries).tolist() and merged["size"].sum() == 400
    assert len(merge_runs_of([])) == 0


def test_rounds_are_binomial(docs_of):
    docs = docs_of([(i, f"t{i % 500}") for i in range(1000)]).repartition(4)
    found = digests(docs)
    plan = merge_runs(found, 1000, rows_per_slot=125)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 3


def test_most_characters_stay_then_smallest_id(docs_of):
    kept = {r.doc_id for r in exact_dedup(docs_of(ROWS)).collect() if r.kept}
    assert kept == {5, 1, 2, 4, 6, 10, 12}


def test_repeated_rows_keep_exactly_one(docs_of):
    got = exact_dedup(docs_of([(1, "q"), (1, "q"), (1, "q")])).collect()
    assert [r.keep_id for r in got] == [1, 1, 1] and sum(r.kept for r in got) == 1


def test_empty_table_and_clashing_columns(docs_of):
    assert exact_dedup(docs_of([])).collect() == []
    odd = docs_of([(1, "q"), (2, "q")]).selectExpr("*", "'z' AS TEXT", "1 AS keep_id", "2 AS digest")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup(odd).collect()) == [(1, 1), (2, 1)]


def test_marked_rows_are_those_of_a_semi_join(spark):
    rows = common.numbered(spark.range(0, 100_000, 1, 3).select(F.col("id").alias("v")), "marked-test")
    numbers = rows.where("c0 % 7 = 3 OR c0 < 20 OR c0 BETWEEN 70000 AND 70100").select("row")
    want = {r.c0 for r in rows.join(numbers, "row", "left_semi").collect()}
    got = [r.c0 for r in common.marked(rows, numbers.unionByName(numbers)).collect()]
    assert len(got) == len(want) > 14_000 and set(got) == want
    assert common.marked(rows, numbers.where("row < 0")).collect() == []


def test_texts_are_not_shuffled_when_rows_are_kept(spark, docs_of):
    docs = docs_of([(i, f"text {i // 2} " * 5) for i in range(20_000)]).repartition(3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        kept = keep_distinct(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        ids = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ids == list(range(0, 20_000, 2))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
