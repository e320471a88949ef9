"""Removal of passages that repeat across documents, by deep-shallow suffix sorting.

A passage is a string of ``LENGTH`` bytes; it goes from every document but the ones with the smallest doc_id that has it.

1. In every passage the least hash of its ``GRAM``-byte strings is its anchor. Equal passages have equal anchors
   at equal places, so only anchors that two documents share can matter. Documents are dealt to chunks, each chunk
   sends every anchor once, and gets back the shared ones.
2. For each shared anchor a chunk sends one context: the bytes of all passages in a row that have this anchor,
   with the smallest doc_id; equal contexts of a chunk are sent once.
3. Where an anchor has one context, all its passages repeat together. Else the passages are suffixes of the
   contexts: deep-shallow sorting puts equal ones next to each other, and each class has its smallest doc_id.
4. Chunks get back, per context, the runs of passages with their smallest doc_id, and cut the spans.

What a passage in a third of all documents costs is one anchor and one context per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import pick
from panelforge.llm.bpe import spans
from panelforge.llm.deep_shallow import sort_suffixes

#: Longer grams are shared by chance less often as documents are added, shorter ones make fewer anchors.
LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Documents of a chunk and of a bin on average, and passages whose anchors are looked for together.
CHUNK_DOCS, BIN_DOCS, TOGETHER = 2000, 4000, 1 << 20
LAST = np.iinfo(np.int64).max
#: Anchors travel as their upper 40 bits; an accidental equality only costs a useless context.
DROPPED_BITS = np.uint64(24)
CONTEXT = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("offset", "u1"), ("size", "u1"), ("several", "u1")])
RUN = np.dtype([("context", "<u8"), ("first", "u1"), ("last", "u1"), ("doc", "<i8")])


class Chunk:
    """Texts of a chunk as bytes, with the passages of each anchor."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_numpy()
        self.raws = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]

    def parts(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
        """``(bytes, place in them, document, place in it)`` of the passages, a bounded number at a time."""
        held, docs, froms, counts, n = [], [], [], [], 0
        for k, raw in enumerate(self.raws):
            for at in range(0, len(raw) - LENGTH + 1, TOGETHER):
                piece = raw[at : at + TOGETHER + LENGTH - 1]
                if n + len(piece) > TOGETHER and held:
                    yield self._part(held, docs, froms, counts)
                    held, docs, froms, counts, n = [], [], [], [], 0
                held.append(piece)
                docs.append(k)
                froms.append(at)
                counts.append(len(piece) - LENGTH + 1)
                n += len(piece)
        if held:
            yield self._part(held, docs, froms, counts)

    @staticmethod
    def _part(held, docs, froms, counts):
        sizes = np.array([len(p) for p in held])
        starts, counts = np.cumsum(sizes) - sizes, np.array(counts)
        place = spans(starts, counts)
        return (
            b"".join(held),
            place,
            np.repeat(np.array(docs), counts),
            place - np.repeat(starts - np.array(froms), counts),
        )

    def anchors(self) -> Iterator[tuple]:
        """Per part: ``bytes, hash, first and last place, offset of the anchor, document, place in it``."""
        for raw, place, doc, inside in self.parts():
            grams = gram_hashes(raw)
            least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
            width = 1
            while width * 2 <= WINDOW:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            rest = WINDOW - width
            least = np.minimum(least[:-rest], least[rest:])
            anchor = (least[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(
                np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
            )
            end = np.concatenate([new[1:], [len(anchor)]]) - 1
            at = anchor[new]
            hashes = grams[at] >> DROPPED_BITS
            yield raw, hashes, place[new], place[end], at - place[new], doc[new], inside[new]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place; the last places look into zeros."""
    n = len(raw)
    padded = raw + bytes(4 * GRAM)
    words = np.empty(n + GRAM, np.uint64)
    for o in range(8):
        rows = words[o::8]
        rows[:] = np.frombuffer(padded, "<u8", count=len(rows), offset=o)
    x = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += words[8 : n + 8]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x += words[16 : n + 16]
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def context_hashes(raw: bytes, first: np.ndarray, last: np.ndarray, offset: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    found = (
        digest(raw[a : b + LENGTH], o) for a, b, o in zip(first.tolist(), last.tolist(), offset.tolist(), strict=True)
    )
    return np.fromiter(found, np.uint64, len(first))


def _pack(values: np.ndarray) -> bytes:
    """40-bit numbers, sorted, as five bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def by_bin(bins: np.ndarray, count: int):
    order = np.argsort(bins, kind="stable")
    cuts = np.searchsorted(bins[order], np.arange(count + 1))
    for b in range(count):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def send_anchors(bins: int):
    """Step 1: the distinct anchors of a chunk; those that several of its documents have are apart."""

    def run(key, table):
        chunk = Chunk(table)
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, hashes, _, _, _, doc, _ in chunk.anchors():
            found[0].append(hashes)
            found[1].append(chunk.ids[doc])
        hashes, ids = (np.concatenate(f) for f in found)
        order = np.argsort(hashes, kind="stable")
        hashes, ids = hashes[order], ids[order]
        out = {"bin": [], "chunk": [], "lone": [], "several": []}
        if len(hashes):
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            several = np.minimum.reduceat(ids, new) < np.maximum.reduceat(ids, new)
            hashes = hashes[new]
            for b, rows in by_bin((hashes % np.uint64(bins)).astype(np.int64), bins):
                out["bin"].append(b)
                out["chunk"].append(key[0].as_py())
                out["lone"].append(_pack(hashes[rows[~several[rows]]]))
                out["several"].append(_pack(hashes[rows[several[rows]]]))
        return pa.table(out, schema=pa.schema([("bin", pa.int64()), ("chunk", pa.int64()), ("lone", pa.binary()), ("several", pa.binary())]))

    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    """The anchors of a bin that two documents have, for each chunk that sent them."""
    lone = [_unpack(x) for x in table.column("lone").to_pylist()]
    several = [_unpack(x) for x in table.column("several").to_pylist()]
    singles = np.sort(np.concatenate(lone))
    twice = singles[1:][singles[1:] == singles[:-1]]
    known = np.unique(np.concatenate([twice, *several]))
    replies = [_pack(np.concatenate([s, x[_within(x, known)]])) for x, s in zip(lone, several, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "shared": pa.array(replies, pa.binary())})


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values


def send_contexts(bins: int):
    """Step 2: the contexts of the shared anchors of a chunk, equal ones once."""

    def run(key, docs, replies):
        out = {"bin": [], "chunk": [], "contexts": []}
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *map(_unpack, replies.column("shared").to_pylist())]))
        heads, hashes, texts = [np.zeros(0, CONTEXT)], [np.zeros(0, np.uint64)], []
        chunk = Chunk(docs)
        for raw, anchor, first, last, offset, doc, _ in chunk.anchors():
            chosen = np.flatnonzero(_within(anchor, known))
            names = context_hashes(raw, first[chosen], last[chosen], offset[chosen])
            order = np.argsort(names, kind="stable")
            chosen, names = chosen[order], names[order]
            if not len(names):
                continue
            new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            ids, one = chunk.ids[doc[chosen]], chosen[new]
            rows = np.zeros(len(new), CONTEXT)
            rows["anchor"], rows["offset"] = anchor[one], offset[one]
            rows["doc"] = np.minimum.reduceat(ids, new)
            rows["several"] = rows["doc"] < np.maximum.reduceat(ids, new)
            rows["size"] = last[one] - first[one] + LENGTH
            heads.append(rows)
            hashes.append(names[new])
            texts.extend(raw[a : b + LENGTH] for a, b in zip(first[one].tolist(), last[one].tolist(), strict=True))
        heads, hashes = np.concatenate(heads), np.concatenate(hashes)
        if len(heads):
            order = np.argsort(hashes, kind="stable")  # equal contexts of different parts
            new = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
            rows = heads[order[new]]
            low = np.minimum.reduceat(heads["doc"][order], new)
            high = np.maximum.reduceat(heads["doc"][order], new)
            rows["several"] |= np.maximum.reduceat(heads["several"][order], new) | (low < high)
            rows["doc"] = low
            texts = [texts[i] for i in order[new].tolist()]
            pack = zstandard.ZstdCompressor(level=3).compress
            for b, mine in by_bin((rows["anchor"] % np.uint64(bins)).astype(np.int64), bins):
                out["bin"].append(b)
                out["chunk"].append(key[0].as_py())
                n = np.int64(len(mine)).tobytes()
                columns = b"".join(rows[c][mine].tobytes() for c in CONTEXT.names)
                out["contexts"].append(pack(n + columns + b"".join(texts[i] for i in mine.tolist())))
        return pa.table(out, schema=pa.schema([("bin", pa.int64()), ("chunk", pa.int64()), ("contexts", pa.binary())]))

    return run


def _contexts(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
    rows = np.zeros(n, CONTEXT)
    for name in CONTEXT.names:
        kind = CONTEXT[name]
        rows[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return rows, raw[at:]


def first_holders(table: pa.Table) -> pa.Table:
    """Step 3: for every context of a bin the runs of its passages with the smallest doc_id that has them."""
    heads, texts = zip(*map(_contexts, table.column("contexts").to_pylist()), strict=True)
    chunk = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    rows, text = np.concatenate(heads), b"".join(texts)
    size = rows["size"].astype(np.int64)
    start = np.cumsum(size) - size
    names = context_hashes(text, start, start + size - LENGTH, rows["offset"])
    order = np.lexsort((names, rows["anchor"]))
    # distinct contexts
    sorted_names, sorted_anchor = names[order], rows["anchor"][order]
    new = np.concatenate([[True], (sorted_names[1:] != sorted_names[:-1]) | (sorted_anchor[1:] != sorted_anchor[:-1])])
    of = np.empty(len(rows), np.int64)
    of[order] = np.cumsum(new) - 1
    cut = np.flatnonzero(new)
    holder = np.minimum.reduceat(rows["doc"][order], cut)
    where, count = start[order][cut], size[order][cut] - LENGTH + 1
    anchor = sorted_anchor[cut]
    alone = np.concatenate([[True], anchor[1:] != anchor[:-1]]) & np.concatenate([anchor[1:] != anchor[:-1], [True]])

    run_of = [np.flatnonzero(alone)]
    run_first, run_last, run_doc = [np.zeros(alone.sum(), np.int64)], [count[alone] - 1], [holder[alone]]
    mixed = np.flatnonzero(~alone)
    if len(mixed):
        suffix = spans(where[mixed], count[mixed])
        owner = np.repeat(mixed, count[mixed])
        inside = suffix - np.repeat(where[mixed], count[mixed])
        padded = np.frombuffer(text + bytes(2 * LENGTH), np.uint8)
        perm, common = sort_suffixes(padded, suffix, LENGTH)
        cuts = np.flatnonzero(common < LENGTH)
        least = np.minimum.reduceat(holder[owner[perm]], cuts)
        doc = np.empty(len(suffix), np.int64)
        doc[perm] = np.repeat(least, np.diff(np.concatenate([cuts, [len(suffix)]])))
        begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])]))
        end = np.concatenate([begin[1:], [len(doc)]]) - 1
        run_of.append(owner[begin])
        run_first.append(inside[begin])
        run_last.append(inside[end])
        run_doc.append(doc[begin])
    run_of, run_first, run_last, run_doc = (np.concatenate(x) for x in (run_of, run_first, run_last, run_doc))
    by = np.argsort(run_of, kind="stable")
    counts = np.bincount(run_of, minlength=len(cut))
    begin = np.cumsum(counts) - counts
    pick_run = by[spans(begin[of], counts[of])]
    row = np.repeat(np.arange(len(rows)), counts[of])
    useful = (run_doc[pick_run] < rows["doc"][row]) | (rows["several"][row] == 1)
    row, pick_run = row[useful], pick_run[useful]
    out = np.zeros(len(row), RUN)
    out["context"], out["doc"] = names[row], run_doc[pick_run]
    out["first"], out["last"] = run_first[pick_run], run_last[pick_run]
    cuts = np.searchsorted(chunk[row], np.arange(len(heads) + 1))
    runs = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"chunk": table.column("chunk"), "runs": pa.array(runs, pa.binary())})


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_spans(docs, replies):
    """Step 4: the documents of a chunk without the passages that a smaller doc_id has."""
    chunk = Chunk(docs)
    runs = np.concatenate([np.zeros(0, RUN), *(np.frombuffer(r, RUN) for r in replies.column("runs").to_pylist())])
    runs = runs[np.argsort(runs["context"], kind="stable")]
    sizes = np.array([len(r) for r in chunk.raws], np.int64)
    base = np.cumsum(sizes) - sizes
    steps = np.zeros(int(sizes.sum()) + 1, np.int32)
    for raw, _, first, last, offset, doc, inside in chunk.anchors() if len(runs) else ():
        names = context_hashes(raw, first, last, offset)
        low, high = (np.searchsorted(runs["context"], names, side) for side in ("left", "right"))
        mine = runs[spans(low, high - low)]
        row = np.repeat(np.arange(len(names)), high - low)
        gone = mine["doc"] < chunk.ids[doc[row]]
        row, mine = row[gone], mine[gone]
        begin = base[doc[row]] + inside[row]
        np.add.at(steps, begin + mine["first"], 1)
        np.add.at(steps, begin + mine["last"] + LENGTH, -1)
    gone = np.cumsum(steps[:-1]) > 0
    found, kept = [], []
    for k, raw in enumerate(chunk.raws):
        mine = gone[base[k] : base[k] + sizes[k]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
        found.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
        kept.append(np.frombuffer(raw, np.uint8)[~mine].tobytes() if len(edges) else raw)
    ids = pa.array(chunk.ids, pa.int64(), mask=chunk.ids == LAST)
    return pa.table(
        {"doc_id": ids, "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(found, SPANS), "kept": pa.array(kept, pa.binary())}
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs``.

    ``spans`` are the removed runs of bytes (``start``, ``end`` beyond the last), ``kept`` the other bytes. A null
    text is empty; texts below ``LENGTH`` bytes lose nothing. Rows repeated under one doc_id do not cut each
    other; a row without a doc_id counts as larger than all, so it loses what others have. Other columns
    are not looked at; an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text")
    count = rows.count()
    chunks, bins = max(1, count // CHUNK_DOCS), max(1, count // BIN_DOCS)
    dealt = rows.select(
        F.pmod(F.coalesce(F.xxhash64("doc_id"), F.xxhash64("text")), F.lit(chunks)).alias("chunk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"),
        "text",
    )
    anchors = dealt.groupBy("chunk").applyInArrow(
        send_anchors(bins), "bin long, chunk long, lone binary, several binary"
    )
    shared = anchors.groupBy("bin").applyInArrow(shared_anchors, "chunk long, shared binary")
    contexts = (
        dealt.groupBy("chunk")
        .cogroup(shared.groupBy("chunk"))
        .applyInArrow(send_contexts(bins), "bin long, chunk long, contexts binary")
    )
    runs = contexts.groupBy("bin").applyInArrow(first_holders, "chunk long, runs binary")
    return (
        dealt.groupBy("chunk")
        .cogroup(runs.groupBy("chunk"))
        .applyInArrow(
            cut_spans, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
        )
    )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` from the spans and kept bytes."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
