import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm.quality_rules import RepetitionRules, keep_good, quality_rules
from panelforge.llm.suffixes import covered, maximal_repeats, prefix_intervals, repeats, suffix_array

RULES = RepetitionRules(min_words=5, least_words=4)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_by_hand(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            n = 0
            while i != j and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


def by_hand(text, rules=RULES):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    longest = longest_by_hand(words)
    span = {i + k for i, n in enumerate(longest) if n >= rules.least_words for k in range(n)}
    chars = sum(map(len, words))
    share = sum(len(words[i]) for i in span) / max(1, chars)
    failed = len(words) < rules.min_words or 100 * len(inside) > 50 * len(words)
    kept = not failed and share <= rules.max_covered and max(longest, default=0) <= rules.max_longest * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(inside), share,
            max(longest, default=0), failed, kept)


def random_texts(n, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        vocabulary = [f"w{i}é" for i in range(rng.choice([1, 3, 30, 300]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            words += words[: rng.randint(0, 40)]
        out.append("".join(w + rng.choice([" ", " ", "\n", "\t#"]) for w in words))
    return out


ODD = [None, "", " \n\t", "a", "a\xa0b c", "x " * 3000, "one two three\n" * 4, "\n\n\n", "$$$ %%% | <>", "a\x1cb a\x1cb"]


def test_statistics_match_brute_force(docs_of):
    texts = random_texts(120) + [t for t in ODD if t is None or len(t) < 5000]
    docs = docs_of(list(enumerate(texts)) + [(0, texts[0])])
    got = quality_rules(docs.selectExpr("*", "1 AS TEXT", "2 AS kept", "3 AS N_WORDS"), RULES).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        want = by_hand(texts[row.doc_id])
        assert tuple(row)[1:6] + tuple(row)[7:] == want[:5] + want[6:]
        assert row.covered_fraction == pytest.approx(want[5])


def test_repeats_within_and_never_across_texts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 4, rng.integers(0, 50)) for _ in range(30)] + [np.zeros(300, int), np.arange(40)] * 2
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    got = repeats(np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes), np.repeat(ends, sizes))
    assert got.tolist() == [x for t in texts for x in longest_by_hand(list(t))]
    assert covered(np.array([0, 2, 0, 1, 0]), 2).tolist() == [False, True, True, False, False]


def substrings_by_hand(words):
    """Every repeated sequence with its places, and those of them that are maximal."""
    places = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            places.setdefault(tuple(words[i:j]), []).append(i)
    found = {s: p for s, p in places.items() if len(p) > 1}

    def maximal(s, p):
        ahead = {words[i - 1] if i else None for i in p}
        after = {words[i + len(s)] if i + len(s) < len(words) else None for i in p}
        return (len(ahead) > 1 or None in ahead) and (len(after) > 1 or None in after)

    return found, {s: p for s, p in found.items() if maximal(s, p)}


def test_prefix_intervals_are_the_maximal_repeats():
    rng = np.random.default_rng(3)
    for least in (1, 2, 4):
        for size, letters in [(0, 1), (1, 1), (30, 1), (40, 2), (40, 3), (40, 9)] * 3:
            words = rng.integers(0, letters, size)
            doc, ends = np.zeros(size, int), np.full(size, size)
            suffixes, common = suffix_array(words, doc, ends)
            assert [words[s:].tolist() for s in suffixes] == sorted(words[s:].tolist() for s in range(size))
            everything, want = substrings_by_hand(words.tolist())
            right = {tuple(sorted(p)) for s, p in everything.items() if len(s) >= least}
            assert {tuple(sorted(suffixes[f : e + 1])) for _, f, e in prefix_intervals(common, least)} == right
            found, spans = maximal_repeats(words, doc, suffixes, common, least)
            got = {tuple(words[suffixes[f] :][:n].tolist()): sorted(suffixes[f : e + 1]) for n, f, e in found}
            assert got == {s: p for s, p in want.items() if len(s) >= least}
            inside = {i + k for s, p in want.items() if len(s) >= least for i in p for k in range(len(s))}
            assert set(np.flatnonzero(covered(spans, least))) == inside


def test_one_word_over_and_over_takes_linear_work():
    words = np.zeros(200_000, int)
    suffixes, common = suffix_array(words, words, np.full(len(words), len(words)))
    found, spans = maximal_repeats(words, words, suffixes, common, 8)
    assert len(found) == len(words) - 8 and found[:, 0].max() == len(words) - 1
    assert covered(spans, 8).all()


def test_good_rows_keep_all_columns(docs_of):
    texts = random_texts(60) + [t for t in ODD if t is None or len(t) < 5000]
    docs = docs_of(list(enumerate(texts))).selectExpr("*", "doc_id AS c0", "'q' AS KEPT", "array(1) AS extra")
    good = keep_good(docs, RULES)
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {i for i, t in enumerate(texts) if by_hand(t)[-1]}
    assert keep_good(docs.limit(0)).collect() == [] == quality_rules(docs.limit(0)).collect()


def test_clean_documents_of_the_labels_stay(table):
    judged = quality_rules(table("documents")).join(table("labels"), "doc_id")
    good = judged.where("quality = 1 AND n_words >= 50")
    assert good.where("NOT kept").count() <= 0.01 * good.count()
