"""Suffix arrays of many word sequences at once, with the intervals of their longest common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, text by text, and the common prefix of each with the one before it.

    ``words`` are the word ids of all texts one after the other, ``doc`` the text of each word and ``ends`` the
    end of each word's text. The suffixes of each text are sorted by prefix doubling, in which
    only groups that are still tied are sorted on; the ranks of all rounds then give the common prefix of
    neighbours by halving steps. Suffixes of two texts have none.
    """
    n = len(words)
    common = np.zeros(n, np.int64)
    if n < 2:
        return np.arange(n), common
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    start, several = _groups(key[order])
    final = np.empty(n, np.int64)
    final[order] = start
    tied = order[several]
    levels, width = [final], 1
    while len(tied):
        after = tied + width
        inside = after < ends[tied]
        onward = np.where(inside, final[np.minimum(after, n - 1)] + 1, 0)
        key = final[tied] * (n + 2) + onward
        order = np.argsort(key, kind="stable")
        key, members = key[order], tied[order]
        fresh = final.copy()
        old = fresh[members]
        start, several = _groups(key)
        fresh[members] = old + start - _groups(old)[0]
        tied = members[several]
        width *= 2
        final = fresh
        levels.append(final)
    suffixes = np.empty(n, np.int64)
    suffixes[final] = np.arange(n)
    pairs = np.flatnonzero(levels[0][suffixes[:-1]] == levels[0][suffixes[1:]])
    a, b = suffixes[pairs], suffixes[pairs + 1]
    found = np.zeros(len(pairs), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        i, j = a + found, b + found
        ok = np.maximum(i, j) < n
        same = ok & (ranks[np.minimum(i, n - 1)] == ranks[np.minimum(j, n - 1)])
        found[same] += 1 << level
    common[pairs + 1] = found
    return suffixes, common


def repeats(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``longest_repeats`` of the texts of ``suffix_array``."""
    return longest_repeats(*suffix_array(words, doc, ends))


def longest_repeats(suffixes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest sequence from there on that its text repeats.

    It is the longer common prefix with the two neighbours in the suffix array.
    """
    longest = np.zeros(len(suffixes), np.int64)
    if len(suffixes):
        longest[suffixes] = np.maximum(common, np.append(common[1:], 0))
    return longest


def prefix_intervals(common: np.ndarray, least: int) -> np.ndarray:
    """``length, first, last`` of every interval of the suffix array whose common prefix has ``least`` words or more.

    All suffixes from ``first`` to ``last`` share ``length`` words, and no wider interval does. A stack holds
    the intervals that are still open; only places with so long a prefix are visited. An interval comes after
    those within it.
    """
    out, open_ = [], []
    places = np.flatnonzero(common >= least)
    before = -1
    for place, length in zip(places.tolist(), common[places].tolist(), strict=True):
        first = place - 1
        if place != before + 1:
            out.extend((n, f, before) for n, f in reversed(open_))
            open_ = []
        while open_ and open_[-1][0] > length:
            n, first = open_.pop()
            out.append((n, first, before))
        if not open_ or open_[-1][0] < length:
            open_.append((length, first))
        before = place
    out.extend((n, f, before) for n, f in reversed(open_))
    return np.array(out, np.int64).reshape(-1, 3)


def maximal_repeats(
    words: np.ndarray, doc: np.ndarray, suffixes: np.ndarray, common: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of maximal repeats, and for each position the longest one that begins there (0: none).

    An interval is a maximal repeat unless one and the same word stands before all of its suffixes: then the
    sequence is part of a longer repeat at the same places.
    """
    n = len(suffixes)
    spans = np.zeros(n, np.int64)
    found = prefix_intervals(common, least)
    if not len(found):
        return found, spans
    # the word before each suffix; texts begin with one of their own
    at = suffixes - 1
    begins = (suffixes == 0) | (doc[np.maximum(at, 0)] != doc[suffixes])
    before = np.where(begins, -1 - suffixes, words[np.maximum(at, 0)])
    changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
    found = found[changes[found[:, 2]] > changes[found[:, 1]]]
    spans[suffixes] = _innermost(found, n)
    return found, spans


def _innermost(found: np.ndarray, n: int) -> np.ndarray:
    """For each place of the suffix array, the length of the innermost interval around it (0: none).

    Intervals lie within each other or apart, so a walk over their ends cuts the array into pieces of one owner each.
    """
    edges, lengths, around = [0], [0], []

    def leave():
        edges.append(around.pop()[1] + 1)
        lengths.append(around[-1][0] if around else 0)

    for length, first, last in found[np.lexsort([-found[:, 2], found[:, 1]])].tolist():
        while around and around[-1][1] < first:
            leave()
        edges.append(first)
        lengths.append(length)
        around.append((length, last))
    while around:
        leave()
    return np.repeat(np.array(lengths, np.int64), np.diff(np.array([*edges, n])))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: the place where each one's group begins, and whether it has others."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    return np.repeat(first, size), np.repeat(size, size) > 1


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Marks the positions within the spans of all repeats of at least ``least``."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + longest[starts], -1)
    return np.cumsum(steps[:-1]) > 0
