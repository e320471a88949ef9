import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import deep_shallow
from panelforge.llm import suffix_dedup as s
from panelforge.llm.deep_shallow import sort_suffixes

L = s.LENGTH


def by_hand(rows):
    raws = [((s.LAST if i is None else i), (t or "").encode()) for i, t in rows]
    first = {}
    for i, raw in raws:
        for p in range(len(raw) - L + 1):
            w = raw[p : p + L]
            if first.get(w, s.LAST) > i:
                first[w] = i
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for p in range(len(raw) - L + 1):
            if first.get(raw[p : p + L], s.LAST) < i:
                gone[p : p + L] = b"\1" * L
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = bytes(gone).split(b"\0")
        out.append((i, len(raw), sum(gone), sum(map(bool, runs)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def plain(df):
    return sorted((s.LAST if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in df.collect())


def random_rows(seed=3):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(40, 130))) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                parts.append(p[a : len(p) - rng.randint(0, 20)])
            elif kind < 0.6:
                parts.append("=" * rng.randint(30, 120))
            else:
                parts.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 80))))
        rows.append((i * 7 % 91, "".join(parts)))
    return rows


@pytest.mark.parametrize("together", [1 << 20, 300])
def test_matches_brute_force(docs_of, monkeypatch, together):
    monkeypatch.setattr(s, "CHUNK_DOCS", 17)
    monkeypatch.setattr(s, "BIN_DOCS", 20)
    monkeypatch.setattr(s, "TOGETHER", together)
    rows = random_rows()
    assert plain(s.repeat_digests(docs_of(rows).repartition(3))) == by_hand(rows)


def test_documents_match_brute_force(table):
    docs = table("documents")
    assert plain(s.repeat_digests(docs)) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(docs_of):
    p = "".join(chr(97 + i * i % 26) for i in range(49)) + "é"
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 49), (5, "y" * 50), (6, "y" * 51), (5, "y" * 50), (8, p[:49]), (7, p),
            (9, "q" + p + "q" + p), (None, p), (None, p + "!"), (11, "y " * 100_000), (12, "y " * 60)]
    docs = docs_of(rows).selectExpr("*", "1 AS TEXT", "2 AS chunk", "3 AS bin", "4 AS spans")
    assert plain(s.repeat_digests(docs)) == by_hand(rows)
    assert s.repeat_digests(docs_of([])).collect() == []


def test_spans_and_kept_bytes(docs_of):
    p = "".join(chr(97 + i * 7 % 26) for i in range(60))
    got = {r.doc_id: r for r in s.remove_repeats(docs_of([(1, p), (2, "ab" + p + "cd")])).collect()}
    assert got[1].spans == [] and bytes(got[1].kept) == p.encode()
    assert [tuple(x) for x in got[2].spans] == [(2, 62)] and bytes(got[2].kept) == b"abcd"


@pytest.mark.parametrize("shallow", [8, 16, 32])
def test_suffixes_are_sorted(shallow):
    rng = np.random.default_rng(6)
    text = np.concatenate([rng.integers(97, 99, 800), np.full(90, 97), rng.integers(0, 256, 300), np.tile([1, 2, 3], 60)])
    text = np.concatenate([text, np.zeros(100)]).astype(np.uint8)
    starts = rng.permutation(len(text) - 100)
    perm, common = sort_suffixes(text, starts, 50, shallow)
    keys = [text[a : a + 50].tobytes() for a in starts[perm]]
    assert keys == sorted(keys)
    for before, key, n in zip(keys, keys[1:], common[1:], strict=False):
        same = next((i for i in range(50) if before[i] != key[i]), 50)
        assert n == same


def test_short_strings_shared_by_chance_send_no_contexts():
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    shared = [noise(22) for _ in range(200)]
    docs = [pa.table({"doc_id": [i], "text": ["".join(noise(10) + p for p in shared)]}) for i in (1, 2)]
    anchors = pa.concat_tables(s.send_anchors(1)((pa.scalar(i),), doc) for i, doc in enumerate(docs))
    replies = s.shared_anchors(anchors)
    assert replies.column("shared").to_pylist() == [b"", b""]
    assert s.send_contexts(1)((pa.scalar(0),), docs[0], replies.slice(0, 1)).num_rows == 0


def test_suffixes_that_are_all_equal_meet_no_trie(monkeypatch):
    seen = []
    trie = deep_shallow.blind_order
    monkeypatch.setattr(deep_shallow, "blind_order", lambda text, starts, depth: seen.append(starts) or trie(text, starts, depth))
    rng = np.random.default_rng(2)
    passages = [rng.integers(0, 256, 50) for _ in range(20)]
    late = passages[0].copy()
    late[49] ^= 1
    text = np.concatenate([*passages, *passages, late, np.zeros(100)]).astype(np.uint8)
    starts = np.arange(41) * 50
    perm, common = sort_suffixes(text, starts, 50)
    keys = [text[a : a + 50].tobytes() for a in starts[perm]]
    assert keys == sorted(keys) and sorted(common.tolist())[-21:] == [49, *[50] * 20]
    assert [sorted(x) for x in seen] == [[0, 1000, 2000]]
