"""Ranked lexical search with K2-treaps over the grid of terms and documents.

1. Each partition of documents packs its rows into shards of at most ``SHARD_BYTES`` of text and ``SHARD_DOCS`` documents
   (a longer document is a shard of its own), without a shuffle: terms, their number of documents, and the number of
   occurrences of every term in every document.
2. With the counts over all documents a shard becomes a K2-treap: a quadtree over its terms (rows) and its documents
   (columns, by doc_id), both stretched to the same power of two. A cell that holds an occurrence has one bit in the
   bitmap of its parent and the largest impact below it, stored as what is missing to its parent's. Treaps are
   written once.
3. In a unit, one shard and one block of items, the row paths of an item's terms descend together: a document range is
   bounded by the sum of the terms' weights times the impacts of their cells, the ranges with the highest bounds
   are halved first, and a range that cannot reach the ``k``-th score so far is left. At single documents the bound
   is the score.
4. Each unit sends the ``k`` best of its shard; the best of these per item stay.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import pick, release, releasing
from panelforge.session import pin

SHARD_DOCS, SHARD_BYTES = 8192, 8 << 20
#: Items of a unit, those that descend together, and the ranges of an item that are halved in one round.
BLOCK_ITEMS, TOGETHER, WIDTH = 1024, 64, 32
#: Rows are told apart before columns are: only so many levels of the grid split both.
OVERLAP = 3
#: Bytes of one text that are split into terms at a time.
PIECE = 1 << 20
#: ASCII letters and digits and everything beyond ASCII make terms, A-Z count as a-z.
TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c in TERM_BYTES else 32 for c in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_SCHEMA = "shard long, docs long, tokens long, terms array<binary>, found array<int>, packed binary"
HITS = pa.schema([(name, pa.int64()) for name in ("item", "item_id", "doc_id", "place", "score")])
HIT_SCHEMA = "item long, item_id long, doc_id long, place long, score long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, those of about ``PIECE`` bytes at a time."""
    first = 0
    while first < len(raw):
        end = first + PIECE
        while end < len(raw) and FOLDED[raw[end]] != 32:
            end += 1
        yield raw[first:end].translate(FOLDED).split()
        first = end


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))) as found:
        return {name: found[name] for name in found.files}


class Shard:
    """Documents on their way into a shard."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, place, number of terms
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, place: int, raw: bytes) -> None:
        self.bytes += len(raw)
        codes, counts, n, known = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, self.terms
        for found in terms_of(raw):
            more = np.fromiter((known.setdefault(t, len(known)) for t in found), np.int64, len(found))
            n += len(found)
            codes, place_of = np.unique(np.concatenate([codes, more]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(len(more), np.int64)])
            counts = np.bincount(place_of.reshape(-1), weights, len(codes)).astype(np.int64)
        if n:
            self.docs.append((doc_id, place, n))
            self.codes.append(codes)
            self.counts.append(counts)

    def row(self, shard: int) -> dict:
        """Columns by doc_id (null last), terms by falling number of documents: equals are neighbours in the grid."""
        order = sorted(range(len(self.docs)), key=lambda i: (self.docs[i][0] is None, self.docs[i][0] or 0, self.docs[i][1]))
        codes = np.concatenate([self.codes[i] for i in order])
        columns = np.repeat(np.arange(len(order)), [len(self.codes[i]) for i in order])
        found = np.bincount(codes, minlength=len(self.terms))
        by_found = np.argsort(-found, kind="stable")
        rank = np.empty_like(by_found)
        rank[by_found] = np.arange(len(by_found))
        names = list(self.terms)
        ids = [self.docs[i][0] for i in order]
        packed = pack(
            ids=np.array([i or 0 for i in ids], np.int64),
            no_id=np.array([i is None for i in ids], bool),
            places=np.array([self.docs[i][1] for i in order], np.int64),
            sizes=np.array([self.docs[i][2] for i in order], np.int64),
            rows=rank[codes].astype(np.int32),
            columns=columns.astype(np.int32),
            counts=np.concatenate([self.counts[i] for i in order]).astype(np.int32),
        )
        return {
            "shard": shard,
            "docs": len(order),
            "tokens": sum(self.docs[i][2] for i in order),
            "terms": [names[i] for i in by_found],
            "found": found[by_found].tolist(),
            "packed": packed,
        }


def forward_shards(docs: DataFrame) -> DataFrame:
    """Step 1. Documents without a term are in no shard; repeated rows are documents of their own."""
    kinds = pa.schema(
        [
            ("shard", pa.int64()),
            ("docs", pa.int64()),
            ("tokens", pa.int64()),
            ("terms", pa.list_(pa.binary())),
            ("found", pa.list_(pa.int32())),
            ("packed", pa.binary()),
        ]
    )

    def run(batches):
        held = Shard()

        def full():
            row = held.row(held.docs[0][1])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, (place, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw = texts[i].as_py() or b""
                if held.docs and (held.bytes + len(raw) > SHARD_BYTES or len(held.docs) >= SHARD_DOCS):
                    yield full()
                    held = Shard()
                held.add(doc_id, place, raw)
            del batch
            release()
        if held.docs:
            yield full()
            release()

    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text").mapInArrow(run, SHARD_SCHEMA)


def impacts(counts: np.ndarray, sizes: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """The saturated share of a term's occurrences: 64-bit integers, divisions round down.

    Fixed values: the constants of the score.
    """
    m = 100 - 25 + (25 * sizes * docs) // tokens
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int) -> dict[str, np.ndarray]:
    """The K2-treap of a sparse grid: ``bits`` of all inner cells, level by level, and ``less``, a cell's value below its parent's."""
    row_bits, column_bits = max(n_rows - 1, 0).bit_length(), max(n_columns - 1, 0).bit_length()
    levels = row_bits + max(0, column_bits - OVERLAP)
    row_shift = levels - row_bits
    code = _interleave(rows.astype(np.uint64) << np.uint64(row_shift), columns.astype(np.uint64), levels)
    order = np.argsort(code, kind="stable")
    code, most = code[order], values[order].astype(np.int64)
    digits, less = [], []
    for _ in range(levels):  # from single cells up to the root
        parent = code >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        highest = np.maximum.reduceat(most, starts)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        digits.append(4 * group + (code & np.uint64(3)).astype(np.int64))
        less.append(highest[group] - most)
        code, most = parent[starts], highest
    digits, less = digits[::-1], less[::-1]
    bits = [np.zeros(4 * n, bool) for n in [1, *(len(d) for d in digits)][:-1]] if levels else []
    for level, d in zip(bits, digits, strict=True):
        level[d] = True
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    return {
        "bits": np.packbits(flat),
        "less": np.concatenate([*less, np.zeros(0, np.int64)]).astype(np.int32),
        "shape": np.array([levels, row_shift, len(flat), most[0] if len(most) else 0], np.int64),
    }


def _interleave(rows: np.ndarray, columns: np.ndarray, levels: int) -> np.ndarray:
    code = np.zeros(len(rows), np.uint64)
    for b in range(levels):
        one, at = np.uint64(1), np.uint64(b)
        code |= ((columns >> at) & one) << np.uint64(2 * b) | ((rows >> at) & one) << np.uint64(2 * b + 1)
    return code


class Treap:
    """A K2-treap that can be descended: cells are numbered level by level, the root is 0."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.levels, self.row_shift, size, root = arrays["shape"].tolist()
        self.bits = np.unpackbits(arrays["bits"], count=size).astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32)
        parents = (np.flatnonzero(self.bits) >> 2).astype(np.int64)
        self.most = np.empty(len(parents) + 1, np.int64)
        self.most[0] = root
        self.most[1:] = -arrays["less"].astype(np.int64)
        first = 1
        for _ in range(self.levels):  # a level's values follow from those of the level above
            last = first + int(np.searchsorted(parents[first - 1 :], first))
            self.most[first:last] += self.most[parents[first - 1 : last - 1]]
            first = last

    def child(self, cells: np.ndarray, quarter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the cells have that quarter, and the numbers of those quarters."""
        at = 4 * cells + quarter
        there = self.bits[at]
        return there, self.rank[at[there]].astype(np.int64)


class Frontier:
    """Document ranges in waiting: item, level, first column and bound, and the cells of the item's terms in each."""

    def __init__(self):
        self.item = self.level = self.column = self.bound = self.start = self.size = np.zeros(0, np.int64)
        self.cell = self.term = np.zeros(0, np.int64)

    def add(self, item, level, column, bound, size, cell, term) -> None:
        start = np.cumsum(size) - size + len(self.cell)
        for name, more in (("item", item), ("level", level), ("column", column), ("bound", bound), ("start", start), ("size", size), ("cell", cell), ("term", term)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def keep(self, mask: np.ndarray) -> None:
        entries = np.repeat(self.start[mask] - np.cumsum(self.size[mask]) + self.size[mask], self.size[mask]) + np.arange(self.size[mask].sum())
        self.cell, self.term = self.cell[entries], self.term[entries]
        for name in ("item", "level", "column", "bound", "size"):
            setattr(self, name, getattr(self, name)[mask])
        self.start = np.cumsum(self.size) - self.size


def search_treap(treap: Treap, item: np.ndarray, row: np.ndarray, weight: np.ndarray, items: int, columns: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """``(item, column, score)`` of the ``k`` best columns of each item, of equal scores the smaller, and the cells visited.

    ``item, row, weight`` (by item) are the terms of the items; scores are sums of weights times values, those above 0
    count.
    """
    best_score = np.zeros((items, k), np.int64)
    best_column = np.full((items, k), columns, np.int64)
    if not len(treap.most) or not len(item) or not columns:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    row = row.astype(np.int64) << treap.row_shift
    levels, visited = treap.levels, 0
    waiting = Frontier()
    present, size = np.unique(item, return_counts=True)
    bound = np.bincount(item, weight.astype(np.float64), items)[present].astype(np.int64) * treap.most[0]
    zero = np.zeros(len(present), np.int64)
    waiting.add(present, zero, zero, bound, size, np.zeros(len(item), np.int64), np.arange(len(item)))
    while len(waiting.item):
        # what can still be among the best; of equal bounds, a range that begins behind the last of them cannot
        last_score, last_column = best_score[waiting.item, -1], best_column[waiting.item, -1]
        waiting.keep((waiting.bound > last_score) | (waiting.bound == last_score) & (waiting.column < last_column) & (waiting.bound > 0))
        done = waiting.level == levels
        if done.any():
            _offer(best_score, best_column, waiting.item[done], waiting.column[done], waiting.bound[done], columns)
            waiting.keep(~done)
            continue
        if not len(waiting.item):
            break
        order = np.lexsort((waiting.column, -waiting.bound, waiting.item))
        sorted_item = waiting.item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        chosen = np.zeros(len(order), bool)
        chosen[order[place < WIDTH]] = True
        # halve the chosen ranges: each term follows its row into the quarters of both halves
        start, size = waiting.start[chosen], waiting.size[chosen]
        entries = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(size)), size)
        cell, term = waiting.cell[entries], waiting.term[entries]
        parent_item, level, column = waiting.item[chosen], waiting.level[chosen], waiting.column[chosen]
        depth = levels - 1 - level
        quarter = 2 * ((row[term] >> depth[owner]) & 1)
        waiting.keep(~chosen)
        visited += 2 * len(cell)
        for half in (0, 1):
            there, cells = treap.child(cell, quarter + half)
            terms, owners = term[there], owner[there]
            if not len(cells):
                continue
            own, starts, sizes = np.unique(owners, return_index=True, return_counts=True)
            bound = np.add.reduceat(weight[terms] * treap.most[cells], starts)
            waiting.add(parent_item[own], level[own] + 1, column[own] + (half << depth[own]), bound, sizes, cells, terms)
    item_of, slot = np.nonzero(best_score > 0)
    return item_of, best_column[item_of, slot], best_score[item_of, slot], visited


def _offer(best_score, best_column, item, column, score, columns) -> None:
    k = best_score.shape[1]
    touched = np.unique(item)
    item = np.concatenate([np.repeat(touched, k), item])
    score = np.concatenate([best_score[touched].reshape(-1), score])
    column = np.concatenate([best_column[touched].reshape(-1), column])
    order = np.lexsort((column, -score, item))
    take = order[np.searchsorted(item[order], touched)[:, None] + np.arange(k)]
    best_score[touched], best_column[touched] = score[take], column[take]


def treap_shards(shards: DataFrame, docs: int, tokens: int) -> DataFrame:
    """``shard, terms, treap`` of forward shards, with the number of documents and terms of all of them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                grid = unpack(batch.column(2)[i].as_py())
                values = impacts(grid["counts"].astype(np.int64), grid["sizes"][grid["columns"]], docs, tokens)
                n_terms = len(batch.column(1)[i])
                treap = build_treap(grid["rows"], grid["columns"], values, n_terms, len(grid["ids"]))
                raw = pack(ids=grid["ids"], no_id=grid["no_id"], places=grid["places"], **treap)
                yield pa.record_batch(
                    [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([raw], pa.binary())],
                    names=["shard", "terms", "treap"],
                )
            del batch
            release()

    return shards.select("shard", "terms", "packed").mapInArrow(run, "shard long, terms array<binary>, treap binary")


def _search_unit(shard: pa.RecordBatch, lists: pa.Table, k: int) -> pa.Table:
    """The best documents of one shard for each of the items."""
    arrays = unpack(shard.column(1)[0].as_py())
    treap, columns = Treap(arrays), len(arrays["ids"])
    out = []
    for first in range(0, lists.num_rows, TOGETHER):
        part = lists.slice(first, TOGETHER)
        terms = part.column("terms").combine_chunks()
        weight = part.column("weights").combine_chunks().flatten().to_numpy()
        item = np.repeat(np.arange(len(part)), pc.list_value_length(terms).to_numpy())
        row = pc.index_in(terms.flatten(), value_set=shard.column(0).flatten())
        here = ~row.is_null().to_numpy(zero_copy_only=False) & (weight > 0)
        row = row.fill_null(0).to_numpy()[here]
        item, column, score, _ = search_treap(treap, item[here], row, weight[here], len(part), columns, k)
        out.append(
            pa.table(
                [
                    part.column("item").combine_chunks().take(pa.array(item)),
                    part.column("item_id").combine_chunks().take(pa.array(item)),
                    pa.array(arrays["ids"][column], pa.int64(), mask=arrays["no_id"][column]),
                    pa.array(arrays["places"][column], pa.int64()),
                    pa.array(score, pa.int64()),
                ],
                HITS,
            )
        )
    return pa.concat_tables(out) if out else HITS.empty_table()


def item_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, term, n``: the terms of each row of ``items`` and how often it has them."""
    rows = pick(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms"))
    rows = rows.select("item", "item_id", F.explode("terms").alias("term")).withColumn("term", F.col("term").cast("binary"))
    return rows.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("n"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, those above 0.

    Equal scores come by ascending doc_id (null last). Null and empty texts have no terms: such a document is in no
    result and does not count, such an item has none. Rows repeated under one id are documents, or items, of their own.
    Empty tables give no rows; other columns are not looked at.
    """
    wanted = pin(item_terms(items), "item-terms")
    shards = pin(forward_shards(docs), "lexical-shards")
    total = shards.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    n_docs, n_tokens = total.docs or 0, total.tokens or 1
    treaps = pin(treap_shards(shards, n_docs, n_tokens), "treaps")

    each = shards.select(F.explode(F.arrays_zip("terms", "found")).alias("t")).select("t.terms", "t.found")
    asked = wanted.select(F.col("term").alias("terms")).distinct()
    holders = each.join(asked, "terms", "left_semi").groupBy("terms").agg(F.sum("found").alias("df"))
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = holders.select(F.col("terms").alias("term"), weight.cast("long").alias("w"))
    weighted = wanted.join(weights, "term").groupBy("item", "item_id")
    lists = pin(weighted.agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("w") * F.col("n")).alias("weights")), "items")
    blocks = max(1, -(-lists.count() // BLOCK_ITEMS))

    slots = max(1, shards.count())

    def search(treaps: pa.Table, lists: pa.Table) -> pa.Table:
        out = [_search_unit(t, lists, k) for t in treaps.select(["terms", "treap"]).to_batches(max_chunksize=1)]
        return pa.concat_tables(out) if out else HITS.empty_table()

    slot = F.pmod(F.xxhash64("shard"), F.lit(slots)) * blocks
    left = treaps.select("terms", "treap", F.explode(F.sequence(slot, slot + blocks - 1)).alias("unit"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    right = lists.select("*", F.explode(F.sequence(block, block + (slots - 1) * blocks, F.lit(blocks).cast("long"))).alias("unit"))
    hits = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(releasing(search), HIT_SCHEMA)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "place")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
