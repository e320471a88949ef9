import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def official():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


ODD = [
    "", " ", "\n\n  \n x", "don't I'll we've 12 345", "\x1c\x1d \x85\xa0 　a", "日本語のテキスト", "é" * 700,
    "a" * 5000, " " * 3000, "👍🏽👨‍👩‍👧", "<|endoftext|>", "xy" * 900 + "z", "\x00\x01\x7f", "aé" * 2000, "١٢٣ ²½Ⅷ",
    "ab​cd ﻿", "\r\n\t\v\f",
]


def test_odd_texts_match_the_public_library(own, official):
    ids, counts = own.encode(ODD)
    at = 0
    for text, n in zip(ODD, counts, strict=True):
        assert ids[at : at + n].tolist() == official.encode_ordinary(text), text[:20]
        at += n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_matches_the_public_library(own, official, text):
    ids, _ = own.encode([text])
    assert ids.tolist() == official.encode_ordinary(text)
    assert bpe.vocabulary(PATH).decode(ids)[0].tobytes() == text.encode()


def test_long_pieces_merge_as_short_ones_do(own):
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abent ") for _ in range(400)).replace(" ", "").encode() for _ in range(20)]
    for piece, ids in zip(pieces, own.encode_pieces(pieces), strict=True):
        assert own._merge_long(piece).tolist() == ids.tolist()


def test_documents_round_trip(table, official):
    docs = table("documents")
    got = {r.doc_id: r for r in bpe.token_digests(docs).collect()}
    for row in docs.collect():
        ids = official.encode_ordinary(row.text)
        mine = got[row.doc_id]
        assert mine.n_tokens == len(ids)
        assert mine.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert mine.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(docs_of):
    docs = docs_of([(1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "x")])
    got = bpe.token_digests(docs.selectExpr("*", "1 AS TEXT", "2 AS ids", "3 AS decoded")).collect()
    assert sorted(((r.doc_id or 0, r.n_tokens) for r in got)) == [(0, 1), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert got[0].ids_sha256 == got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(docs_of([])).collect() == []
