"""Deep-shallow sorting of suffixes.

Suffixes are first sorted to a shallow depth by multikey quicksort, on words of eight bytes: every segment splits around its
median of three into smaller, equal and larger keys, all segments of a round at once. What then still has
the same beginning is a group with a long common prefix; blind tries order those groups, but for the ones whose members
are all equal, which are in order already.
"""

from __future__ import annotations

import numpy as np

from panelforge.llm.bpe import spans

WORD_BYTES = 8


def words_at(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as one number that sorts like them."""
    words = np.ndarray((max(0, len(text) - WORD_BYTES + 1),), ">u8", np.ascontiguousarray(text), strides=(1,))
    return words[starts].astype(np.uint64)


def multikey_round(keys: np.ndarray, perm: np.ndarray, low: np.ndarray, size: np.ndarray):
    """Splits every segment in place; returns the parts still unequal and the parts equal to a pivot."""
    ends = [keys[low], keys[low + size // 2], keys[low + size - 1]]
    pivot = np.maximum(np.minimum(ends[0], ends[1]), np.minimum(np.maximum(ends[0], ends[1]), ends[2]))
    place = spans(low, size)
    segment = np.repeat(np.arange(len(low)), size)
    held, mine = keys[place], pivot[segment]
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    target = np.empty(len(place), np.int64)
    start, parts = low.copy(), []
    for chosen in (held < mine, held == mine, held > mine):
        count = np.cumsum(chosen)
        before = np.where(first > 0, count[first - 1], 0)
        n = np.add.reduceat(chosen.astype(np.int64), first)
        target[chosen] = (start[segment] + count - 1 - before[segment])[chosen]
        parts.append((start.copy(), n))
        start = start + n
    moved = perm[place]
    keys[target], perm[target] = held, moved
    smaller, equal, larger = parts
    rest = np.concatenate([smaller[0], larger[0]]), np.concatenate([smaller[1], larger[1]])
    return tuple(x[rest[1] > 1] for x in rest), tuple(x[equal[1] > 1] for x in equal)


def blind_order(text: bytes, starts: list[int], depth: int) -> tuple[list[int], list[int]]:
    """The order of ``starts`` by the ``depth`` bytes that follow, and the common prefix with the one before.

    A branch of the trie is ``[position, {byte: child}]`` and looks at no other position; a leaf is ``(key,
    members)``. A new key goes down blindly, is compared with the one leaf it ends at, and goes in where the two
    part.
    """
    root = None
    for i, start in enumerate(starts):
        key = text[start : start + depth]
        if root is None:
            root = (key, [i])
            continue
        node = root
        while type(node) is list:
            kids = node[1]
            node = kids.get(key[node[0]]) or next(iter(kids.values()))
        other, members = node
        if other == key:
            members.append(i)
            continue
        apart = (int.from_bytes(key) ^ int.from_bytes(other)).bit_length()
        common = depth - (apart + 7) // 8
        parent, node = None, root
        while type(node) is list and node[0] < common:
            parent, node = node, node[1][key[node[0]]]
        leaf = (key, [i])
        if type(node) is list and node[0] == common:
            node[1][key[common]] = leaf
        else:
            branch = [common, {other[common]: node, key[common]: leaf}]
            if parent is None:
                root = branch
            else:
                parent[1][key[parent[0]]] = branch
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is list:
            kids = sorted(node[1].items(), reverse=True)
            stack.extend((child, node[0]) for _, child in kids[:-1])
            stack.append((kids[-1][1], shared))
        else:
            order.extend(node[1])
            common.extend([shared] + [depth] * (len(node[1]) - 1))
    return order, common


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 16):
    """``(order, common)``: ``starts`` in order of the ``depth`` bytes that follow each one.

    ``common`` is the number of leading bytes, up to ``depth``, that each shares with the one before it (0 for the
    first). ``shallow`` is a multiple of eight; ``text`` reaches ``depth`` and ``shallow`` beyond every start.
    """
    n = len(starts)
    perm, common = np.arange(n), np.zeros(n, np.int64)
    low, size = np.array([0]), np.array([n])
    low, size = low[size > 1], size[size > 1]
    for at in range(0, shallow, WORD_BYTES):
        equal = []
        if not len(low):
            break
        keys = np.zeros(n, np.uint64)
        place = spans(low, size)
        keys[place] = words_at(text, starts[perm[place]] + at)
        inner = np.ones(n, bool)
        inner[low] = False
        while len(low):
            (low, size), same = multikey_round(keys, perm, low, size)
            equal.append(same)
        later = place[inner[place]]
        apart = keys[later] ^ keys[later - 1]
        common[later] = np.where(apart > 0, at + _zero_bytes(apart), at + WORD_BYTES)
        low, size = (np.concatenate(x) for x in zip(*equal, strict=True))
    if len(low):
        place, ends = spans(low, size), np.cumsum(size)
        mine, first, same = starts[perm[place]], np.repeat(starts[perm[low]], size), np.ones(len(place), bool)
        for at in range(shallow, depth, WORD_BYTES):
            at = min(at, depth - WORD_BYTES)
            same &= words_at(text, mine + at) == words_at(text, first + at)
        alike = np.logical_and.reduceat(same, ends - size)
        later = np.repeat(alike, size)
        later[ends - size] = False
        common[place[later]] = depth
        low, size = low[~alike], size[~alike]
    raw = text.tobytes() if len(low) else b""
    for lo, m in zip(low.tolist(), size.tolist(), strict=True):
        members = perm[lo : lo + m]
        order, shared = blind_order(raw, starts[members].tolist(), depth)
        perm[lo : lo + m] = members[order]
        common[lo + 1 : lo + m] = shared[1:]
    return perm, common


def _zero_bytes(apart: np.ndarray) -> np.ndarray:
    """Leading zero bytes of numbers above zero."""
    out = np.zeros(len(apart), np.int64)
    for k in range(1, WORD_BYTES):
        out += apart < np.uint64(1) << np.uint64(64 - 8 * k)
    return out
