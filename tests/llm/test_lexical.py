import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from panelforge.llm import lexical
from panelforge.llm.lexical import TERM, Treap, build_treap, ranked_search, search_treap, terms_of

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
FOLD = {c: c + 32 for c in range(65, 91)}


def split(text):
    return re.findall(TERM, (text or "").translate(FOLD))


def brute(docs, items, k=20):
    found = [(i, Counter(split(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    out = []
    for item, text in items:
        scores = []
        asked = Counter(split(text))
        weight = {
            t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
            for t in asked
            if (df := sum(t in c for _, c in found))
        }
        for i, c in found:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(asked[t] * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("docs_per_shard", [7, 5000])
def test_whole_tables_match_brute_force(table, monkeypatch, docs_per_shard):
    monkeypatch.setattr(lexical, "SHARD_DOCS", docs_per_shard)
    docs, items = table("documents"), table("benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(ranked_search(docs, items)) == want


def test_odd_rows_ties_repeats_and_long_texts(spark, docs_of):
    rows = [(i, f"alpha w{i % 5} beta") for i in range(60, 0, -1)]
    rows += [(7, "alpha w2 beta"), (None, "gamma alpha"), (None, "gamma alpha"), (100, None), (101, ""), (102, " \n--")]
    rows += [(200, "Größe ÄÖ KK alpha_beta x"), (201, "word " * 300_000 + "zeta"), (202, "e" * 2_500_000 + " zeta")]
    items = [(1, "alpha beta beta"), (2, "ZETA gamma"), (3, None), (4, "--"), (None, "gamma"), (1, "w3"), (6, "größe äÖ kK x"), (7, "e" * 2_500_000)]
    docs = docs_of(rows).selectExpr("*", "1 AS item", "'z' AS TEXT", "2 AS place")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 AS doc_id", "'z' AS Text")
    assert found(ranked_search(docs.repartition(3), asked, k=6)) == brute(rows, items, 6)


def test_items_in_several_blocks(docs_of, spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(lexical, "TOGETHER", 3)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 9)
    rows = [(i, " ".join(f"t{(i * j) % 17}" for j in range(1, 9))) for i in range(50)]
    items = [(i, f"t{i} t{(3 * i) % 17} t1") for i in range(17)]
    assert found(ranked_search(docs_of(rows), spark.createDataFrame(items, ITEMS), k=3)) == brute(rows, items, 3)


def test_empty_tables(spark, docs_of):
    none, one = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a")], ITEMS)
    assert ranked_search(docs_of([]), one).collect() == []
    assert ranked_search(docs_of([(1, "a b")]), none).collect() == []
    assert ranked_search(docs_of([(1, None)]), one).collect() == []


def test_terms_do_not_depend_on_the_pieces(monkeypatch):
    text = "Ab-c ñandú 12x,,ÉÉ " * 40
    whole = [t for part in terms_of(text.encode()) for t in part]
    monkeypatch.setattr(lexical, "PIECE", 5)
    assert [t for part in terms_of(text.encode()) for t in part] == whole == [t.encode() for t in split(text)]


def test_search_of_a_treap_visits_only_a_part_of_the_grid():
    chance = np.random.default_rng(4)
    cells = np.unique(chance.integers(0, 500 * 3000, 60_000))
    rows, columns = cells // 3000, cells % 3000
    values = (1000 * chance.pareto(1.0, len(cells))).astype(np.int64) + 1
    treap = Treap(build_treap(rows, columns, values, 500, 3000))
    item = np.repeat(np.arange(20), 6)
    asked = np.concatenate([chance.choice(500, 6, replace=False) for _ in range(20)])
    weight = chance.integers(1, 9, 120)
    got = search_treap(treap, item, asked, weight, 20, 3000, 5)
    for i in range(20):
        score = np.zeros(3000, np.int64)
        for r, w in zip(asked[item == i], weight[item == i], strict=True):
            score[columns[rows == r]] += w * values[rows == r]
        best = sorted(range(3000), key=lambda c: (-score[c], c))[:5]
        assert [(c, s) for j, c, s in zip(*got[:3], strict=True) if j == i] == [(c, score[c]) for c in best]
    assert got[3] < 0.5 * search_treap(treap, item, asked, weight, 20, 3000, 3000)[3]
