"""Byte-level BPE on padded numpy matrices.

The pieces of many texts are encoded together. Distinct pieces are sorted into buckets by length; a bucket is one
matrix with a piece per row. In each round every row merges its leftmost pair of least rank: pair ranks
come from a hash table in two arrays, rows shift left over the merged token, and rows without a pair leave the
matrix. A piece longer than the widest matrix is merged with a heap, which costs n log n instead of n * n.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import map_arrow, pick, text_parts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NO_PAIR = np.iinfo(np.int32).max
WIDEST = 1024
CELLS = 1 << 18
#: Entries of the cache of encoded pieces; a full cache is thrown away and begun anew.
CACHED_PIECES, CACHED_IDS = 100_000, 4_000_000
#: Characters of texts that are encoded together, and ids that are decoded together.
TOGETHER = 1 << 18


class PairTable:
    """Ranks of token pairs by open addressing with linear probes."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several that want one slot the last gets it
            got = self.keys[slot] == keys
            self.ranks[slot[got]] = ranks[got]
            keys, ranks, slot = keys[~got], ranks[~got], (slot[~got] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        found = np.where(self.keys[slot] == keys, self.ranks[slot], NO_PAIR)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (here != -1)]
        return found


class Codec:
    """Encodes with the ranks of one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, ranks = array("q"), array("i")
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ranks.append(rank)
        self.pairs = PairTable(np.frombuffer(keys, np.int64), np.frombuffer(ranks, np.int32))
        self._forget()

    def _forget(self):
        self.place, self.sizes, self.ids, self.held = {}, [], [], 0
        self.flat = self.flat_size = self.flat_start = None

    # encoding of distinct pieces

    def _merge_rows(self, rows: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The tokens of each row of byte tokens; the columns from ``sizes`` on are padding."""
        n, width = rows.shape
        out: list = [None] * n
        index, columns = np.arange(n), np.arange(width)
        ranks = np.full((n, width), NO_PAIR, np.int32)
        if width > 1:
            real = columns[None, 1:] < sizes[:, None]
            ranks[:, :-1][real] = self.pairs.look_up(rows[:, :-1][real], rows[:, 1:][real])
        while len(index):
            at = ranks.argmin(axis=1)  # the first of equal ranks
            line = np.arange(len(index))
            best = ranks[line, at]
            done = best == NO_PAIR
            for i in np.flatnonzero(done):
                out[index[i]] = rows[i, : sizes[i]].copy()
            if done.any():
                go = ~done
                index, rows, ranks, sizes, at, best = (x[go] for x in (index, rows, ranks, sizes, at, best))
                if not len(index):
                    break
                width = int(sizes.max())
                rows, ranks, columns = rows[:, :width], ranks[:, :width], columns[:width]
                line = np.arange(len(index))
            source = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            rows, ranks = np.take_along_axis(rows, source, 1), np.take_along_axis(ranks, source, 1)
            rows[line, at] = best
            sizes = sizes - 1
            ranks[:, width - 1] = NO_PAIR
            ranks[line, sizes - 1] = NO_PAIR
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < sizes)
                k, j = line[ok], left[ok]
                ranks[k, j] = self.pairs.look_up(rows[k, j], rows[k, j + 1])
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, with a heap of (rank, place)."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.pairs.look_up(ids[:-1], ids[1:])
        ids, n = ids.tolist(), len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(int(r), i) for i, r in enumerate(first) if r != NO_PAIR]
        heapq.heapify(heap)

        def rank(i):
            if i < 0 or after[i] >= n:
                return NO_PAIR
            return int(self.pairs.look_up(np.array([ids[i]]), np.array([ids[after[i]]]))[0])

        current = {i: r for r, i in heap}
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or current.get(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            current.pop(j, None)
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0:
                    new = rank(k)
                    current[k] = new
                    if new != NO_PAIR:
                        heapq.heappush(heap, (new, k))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            elif len(piece) > WIDEST:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault(max(4, (len(piece) - 1).bit_length()), []).append(i)
        for bits, members in buckets.items():
            step = max(1, CELLS >> bits)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                sizes = np.array([len(pieces[i]) for i in part])
                width = int(sizes.max())
                raw = b"".join(pieces[i].ljust(width, b"\0") for i in part)
                rows = self.byte_ids[np.frombuffer(raw, np.uint8).reshape(len(part), width)]
                for i, ids in zip(part, self._merge_rows(rows, sizes), strict=True):
                    out[i] = ids
        return out

    # texts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in a row, and the number of each text."""
        pieces = [self.split(t) for t in texts]
        counts = np.array([len(p) for p in pieces], np.int64)
        flat = [p for text in pieces for p in text]
        if len(self.place) > CACHED_PIECES or self.held > CACHED_IDS:
            self._forget()
        get = self.place.get
        index = [get(p) for p in flat]
        if None in index:
            new = list({p for p, i in zip(flat, index, strict=True) if i is None})
            for piece, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
                self.place[piece] = len(self.sizes)
                self.sizes.append(len(ids))
                self.ids.append(ids)
                self.held += len(ids)
            self.flat = np.concatenate(self.ids)
            self.ids = [self.flat]
            self.flat_size = np.array(self.sizes, np.int64)
            self.flat_start = np.concatenate([[0], np.cumsum(self.flat_size)[:-1]])
            index = [get(p) for p in flat]
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        index = np.array(index, np.int64)
        sizes = self.flat_size[index]
        ids = self.flat[spans(self.flat_start[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[bounds])


class Vocabulary:
    """The bytes of each id of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, lines)]
        tokens = [b""] * (max(rank for rank, _ in pairs) + 1)
        for rank, token in pairs:
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and the number of each id."""
        sizes = self.size[ids]
        return self.bytes[spans(self.start[ids], sizes)], sizes


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each span, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text.

    A null text is empty and gives an empty list, as an empty one does; control strings are ordinary text. Rows
    repeated under one doc_id are encoded each; other columns are not looked at. ``path`` is a file
    of ranks that every executor has (by default the public vocabulary for many languages).
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch):
        for first, end, texts in text_parts(batch.column(1), TOGETHER):
            ids, counts = codec(path, pattern).encode(texts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.record_batch([batch.column(0).slice(first, end - first), lists], names=["doc_id", "ids"])

    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(plain, run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for; null ids give no bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batch: pa.RecordBatch):
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes), 0
        while first < len(sizes):
            before = ends[first] - sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            part = batch.slice(first, last - first)
            lists = part.column(1)
            raw, widths = vocabulary(path).decode(lists.flatten().to_numpy(zero_copy_only=False))
            bytes_to = np.concatenate([[0], np.cumsum(widths)])
            bounds = np.concatenate([[0], np.cumsum(sizes[first:last])])
            offsets = pa.py_buffer(bytes_to[bounds].astype(np.int32).tobytes())
            decoded = pa.Array.from_buffers(
                pa.binary(), last - first, [None, offsets, pa.py_buffer(raw.tobytes())]
            )
            yield pa.record_batch([part.column(0), lists, decoded], names=["doc_id", "ids", "decoded"])
            first = last

    plain = pick(tokens, "doc_id", "ids")
    return map_arrow(plain, run, "doc_id long, ids array<int>, decoded binary")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the encoded and decoded texts."""
    both = decode(encode(docs, path), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
