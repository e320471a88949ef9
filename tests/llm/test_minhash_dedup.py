import random
import re
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import minhash_dedup as m
from panelforge.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def by_hand(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    pairs = {}
    for held in holders.values():
        for x, a in enumerate(held):
            for b in held[x + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), common in pairs.items():
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=2, groups=12):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(2000)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 150, 300]))]
        for _ in range(rng.choice([2, 5, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("size", "percent", "blocks"), [(3, 85, 4096), (5, 80, 4)])
def test_components_match_brute_force(docs_of, monkeypatch, size, percent, blocks):
    monkeypatch.setattr(m, "SIGNATURE_BLOCK", blocks)
    monkeypatch.setattr(m, "SET_BLOCK", blocks)
    rows = near_copies()
    got = m.near_duplicates(docs_of(rows).repartition(4), size, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_hand(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_documents_match_brute_force(table):
    docs = table("documents")
    got = m.near_duplicates(docs, 3, 85).collect()
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_odd_rows(docs_of):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "One two"), (4, "one TWO"), (9, "two one"), (8, "One two"), (None, "one two"),
            (3, "É x y"), (2, "é x y"), (1, "w " * 50_000), (0, "w w w w")]
    docs = docs_of(rows).selectExpr("*", "1 AS TEXT", "2 AS id", "3 AS class", "4 AS cluster")
    got = m.near_duplicates(docs, 3, 85).collect()
    found = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got))
    assert found == [
        (-1, 1, 4, False), (0, 1, 0, True), (1, 1, 0, False), (2, 1, 2, True), (3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 1, 4, False), (8, 1, 4, False), (9, 1, 9, True),
    ]
    assert m.near_duplicates(docs_of([]), 3, 85).collect() == []


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.85, 0.95):
        off = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, int(2000 * similarity)).astype(np.uint64)
            own = rng.integers(0, 1 << 63, 2000 - len(both)).astype(np.uint64)
            sets = [np.concatenate([both, own[::2]]), np.concatenate([both, own[1::2]])]
            least = m.minima(sets) & 1
            off.append(2 * (least[0] == least[1]).mean() - 1 - similarity)
        assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 7), (150, 139)]
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    found = {r.id: r.component for r in got.collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[k] == 100 for k in [*range(100, 140), 150])
    assert found[200] == 200 and len(found) == 61 + 41 + 1


@pytest.mark.parametrize(("similarity", "most"), [(0.85, 1.2e-6), (0.8, 2.2e-4)])
def test_bits_miss_less_than_bands(similarity, most):
    bands = (1 - similarity**m.ROWS) ** m.BANDS
    apart, p, n = int(m.HASHES * (1 - similarity + m.ESTIMATE_SLACK) / 2), (1 - similarity) / 2, m.HASHES - m.ROWS
    bits = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(apart + 1, n + 1))
    assert bits < bands and bands + bits < most


def test_unlucky_signature_of_a_pair_at_the_threshold_is_let_through():
    bits = np.zeros((2, m.HASHES), np.uint8)
    for apart, percent in ((42, 85), (48, 80)):
        bits[1] = np.arange(m.HASHES) < apart
        packed = np.packbits(np.pad(bits, ((0, 0), (0, -m.HASHES % 64))), axis=1)
        table = pa.table({"unit": [1, 1], "id": [3, 4], "bits": [row.tobytes() for row in packed]})
        members, roots = m._signature_stars(percent / 100 - m.ESTIMATE_SLACK)(table)
        assert [x.tolist() for x in members] == [[4]] and [x.tolist() for x in roots] == [[3]]


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    edges += [(1000 + i, 1000 + i + 1) for i in range(300)] + [(5000, 5000 + i) for i in range(1, 400)]
    edges += edges[:50] + [(None, 3), (9999, None)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sets_are_shuffled_only_to_their_units(spark, docs_of, monkeypatch):
    plans, stars = [], m.stars

    def seen(rows, *rest):
        plans.append(rows._jdf.queryExecution().sparkPlan().toString())
        return stars(rows, *rest)

    monkeypatch.setattr(m, "stars", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = near_copies()
        got = m.near_duplicates(docs_of(rows), 5, 80).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == by_hand(rows, 5, 80)
    of_sets = [p for p in plans if "MapInArrow" in p]
    assert len(of_sets) == 1 and "Join" not in of_sets[0].split("MapInArrow")[0]
