"""Mixing, URL rules and chat formatting."""

import hashlib
import random
from collections import defaultdict

import pytest

from panelforge.llm import chat
from panelforge.llm.mixing import mix_sources
from panelforge.llm.url_filter import rule_table, url_filter

WEIGHTS = {"domain": {"d0": 1.0, "d1": 3.0}, "lang": {"en": 2.0}, "source": {"src4": 0.0}}


def fill(budget, nodes):
    """Water filling by repetition: ``nodes`` is ``name -> (weight, capacity)``."""
    given, open_ = {}, {k: v for k, v in nodes.items() if v[0] > 0 and v[1] > 0}
    while open_:
        rate = budget / sum(w for w, _ in open_.values())
        full = {k for k, (w, c) in open_.items() if c <= w * rate}
        if not full:
            return given | {k: w * rate for k, (w, _) in open_.items()}
        for k in full:
            given[k] = open_.pop(k)[1]
            budget -= given[k]
    return given


def mix_by_hand(rows, share, epochs, seed="s"):
    leaves = defaultdict(list)
    for doc_id, text, lang, source in rows:
        if text and text.split():
            number = "".join(c for c in source if c.isdigit())
            leaves[f"d{int(number) % 4}", lang, source].append((doc_id, len(text.split())))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = [lambda n, level=level: WEIGHTS[level].get(n, 1.0) for level in ("domain", "lang", "source")]
    room = {k: v * epochs * all(w(n) for w, n in zip(weight, k, strict=True)) for k, v in supply.items()}
    given = {(): float(int(sum(supply.values()) * share + 1e-6))}
    for depth in range(3):
        below = {}
        for parent, budget in given.items():
            nodes = {}
            for k, c in room.items():
                if k[:depth] == parent:
                    w, held = nodes.get(k[: depth + 1], (weight[depth](k[depth]), 0))
                    nodes[k[: depth + 1]] = (w, held + c)
            below |= fill(budget, nodes)
        given = below
    out = []
    for leaf, budget in given.items():
        budget, epoch = int(budget + 1e-6), 0
        while budget > 0:
            order = sorted(
                leaves[leaf], key=lambda d: (hashlib.md5(f"{seed}:{epoch}:{d[0]}".encode()).hexdigest(), d[1])
            )
            for doc_id, n in order:
                if budget > 0:
                    out.append((doc_id, epoch, min(n, budget)))
                    budget -= n
            epoch += 1
    return sorted(out)


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.9, 2), (1.5, 2), (50.0, 3)])
def test_mix_matches_repetition(docs_of, share, epochs):
    rng = random.Random(3)
    rows = [
        (i, "w " * rng.randint(0, 40), rng.choice(["en", "de"]), rng.choice(["src0"] * 5 + ["src1", "src4", "src5", "src9"]))
        for i in range(400)
    ]
    got = mix_sources(docs_of(rows), WEIGHTS, share, epochs, seed="s").collect()
    assert sorted((r.doc_id, r.epoch, r.taken_tokens) for r in got) == mix_by_hand(rows, share, epochs)


def test_mix_edge_cases(docs_of):
    assert mix_sources(docs_of([]), WEIGHTS, 0.5).collect() == []
    rows = [(1, None, None, None), (2, "a b", None, None), (None, "a b", "en", "x"), (2, "a b", None, None)]
    odd = docs_of(rows).selectExpr("*", "1 AS TEXT", "2 AS epoch", "3 AS bucket", "4 AS supply")
    got = mix_sources(odd, {}, 1.0, 1).collect()
    assert sorted((r.doc_id or 0, r.domain, r.taken_tokens) for r in got) == [(0, "d-", 2), (2, "d-", 2), (2, "d-", 2)]


URLS = [
    (1, "https://Example.ORG/en/123?x#y"), (2, "http://a.example.org/es/"), (3, "http://example.org"),
    (4, "http://xexample.org/es/1"), (5, "ftp://com/de/x"), (6, "x.com/fr/a"), (7, None), (8, ""),
    (9, "http://a.com/fr/?q"), (10, "http://a..com/de/"), (11, "http:///de/"), (12, "a://b://com/de/"),
    (13, "http://a.com/DE/"), (14, "http://h.example.org/en/" + "1" * 50_000), (15, "x://" + "a." * 5_000 + "com/fr/"),
    (1, "https://Example.ORG/en/123?x#y"), (None, "http://É.com/de/"),
]
RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
    ("block", "com/de/"), ("allow", "com/de/"), ("block", "no-slash"), ("block", "/x"),
]


def judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = (0, None, "allow")
    for action, rule in RULES:
        head, _, tail = rule.partition("/")
        fits = head and "/" in rule and (host == head or host.endswith("." + head)) and path.startswith("/" + tail)
        if fits:
            best = max(best, (len(rule), rule, action))
    return host, path, best[1], best[2]


def test_url_rules_match_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "1 AS URL", "2 AS host", "3 AS rule")
    got = url_filter(pages, rule_table(spark, RULES)).collect()
    want = sorted(((p, *judge(u)) for p, u in URLS), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_url_rules_without_rules_or_pages(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    none = rule_table(spark, RULES).limit(0)
    got = url_filter(pages, none, "block").collect()
    assert len(got) == len(URLS) and {r.verdict for r in got} == {"block"} and {r.rule for r in got} == {None}
    assert url_filter(pages.limit(0), rule_table(spark, RULES)).collect() == []


TALKS = [
    (1, 0, "user", "a<|im_end|>&lt;|&amp;<| <"), (1, 1, "assistant", "x" * 1000 + "é<|"), (1, 1, "assistant", "dup"),
    (1, 1, "assistant", "dup"), (2, None, None, None), (2, 3, "assistant", None), (None, 0, "as\nsist<|ant", "\n|"),
    (3, 0, "user", ""), (3, 2, "assistant", "|im_end|>"), (3, 1, "tool&#10;", "w " * 40_000),
]


def test_chat_round_trip(spark):
    table = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    log = chat.event_log(table.selectExpr("*", "1 AS seq", "2 AS TEXT", "3 AS message"))
    formatted = chat.format_chats(log)
    for row in formatted.collect():
        assert row.formatted == "".join(s.text for s in row.segments)
        turns = sum(t[0] == row.conv_id for t in TALKS)
        assert row.formatted.count(chat.START) == row.formatted.count(chat.END) == turns
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in {t[0] for t in TALKS}:
        mine = sorted(((-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in TALKS if t[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        row = got[conv]
        assert row.n_turns == len(mine) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_folds_events_in_sequence(spark):
    log = [
        (1, 7, 0, "user", 3, "delta", "!"), (1, 7, 0, "user", 1, "delta", "old"), (1, 7, 0, "user", 2, "edit", "new"),
        (1, 8, 1, "assistant", 1, "delta", "bad"), (1, 8, 1, "assistant", 4, "delta", "d"),
        (1, 8, 1, "assistant", 2, "regenerate", "ignored"), (1, 8, 1, "assistant", 3, "delta", "goo"),
        (1, 8, 1, None, 5, None, None), (1, 9, 2, "user", 1, "regenerate", None),
    ]
    schema = "conv_id long, message long, turn long, role string, seq int, kind string, text string"
    got = chat.fold(spark.createDataFrame(log, schema)).collect()
    assert sorted((r.turn, r.text) for r in got) == [(0, "new!"), (1, "good"), (2, "")]
    assert chat.format_chats(spark.createDataFrame([], schema)).collect() == []
