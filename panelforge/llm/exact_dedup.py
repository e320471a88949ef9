"""Exact duplicates by a tree merge of sorted digest runs.

Every partition sorts the digests of its rows into a run with one entry per distinct text. The slots then
exchange runs in binomial rounds: a slot splits its run by the next bit of the digest, sends each half to the slot of
its pair that owns this bit, and merges the sorted runs it gets, keeping the best identifier of equal entries. After
the last round each slot owns one range of digests. A text that a third of all rows share is one entry of each
run, so no slot holds more than its share. Entries are sorted once, where they arise; from then on runs are merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import numbered, pick, power_of_two, release, rows_of, text_parts
from panelforge.session import pin

BLANKS = b" \t\n\x0b\x0c\r"
ENTRY = np.dtype(
    [("digest", "S48"), ("chars", "<i8"), ("no_id", "<i8"), ("id", "<i8"), ("row", "<i8"), ("size", "<i8")]
)
#: Bytes of texts held as Python strings at a time.
TOGETHER = 1 << 20
RUN_SCHEMA = "slot int, run binary"
WIN_SCHEMA = "digest binary, keep_id long, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, row, chars, digest``: SHA-256 and BLAKE2b of each text without its blanks.

    A null text counts as empty. ``row`` tells repeated rows apart: the column ``row`` of ``docs`` if ``docs`` is
    ``doc_id, text, row``, else a number that is stable only once the result is written.
    """
    has_row = docs.columns == ["doc_id", "text", "row"]

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            found, chars = [], []
            for text in (t for part in text_parts(batch.column(1), TOGETHER) for t in part[2]):
                raw = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
                found.append(
                    hashlib.sha256(raw).digest() + hashlib.blake2b(raw, digest_size=16).digest()
                )
                chars.append(len(text))
            first = (part << 32) + n
            rows = batch.column(2) if has_row else pa.array(range(first, first + len(chars)), pa.int64())
            n += len(chars)
            yield pa.record_batch(
                [batch.column(0), rows, pa.array(chars, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "row", "chars", "digest"],
            )
            del batch
            release()

    plain = (docs if has_row else pick(docs, "doc_id", "text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.mapInArrow(run, "doc_id long, row long, chars long, digest binary")


def sorted_run(entries: np.ndarray) -> np.ndarray:
    """One entry per digest, by digest: most characters, then smallest identifier (null last), then row."""
    order = np.lexsort([entries["row"], entries["id"], entries["no_id"], -entries["chars"], entries["digest"]])
    run = entries[order]
    if not len(run):
        return run
    starts = np.flatnonzero(np.concatenate([[True], run["digest"][1:] != run["digest"][:-1]]))
    out = run[starts]
    out["size"] = np.add.reduceat(run["size"], starts)
    return out


def _better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where the entry of ``a`` stays rather than that of ``b`` for the same digest."""
    ahead, tied = a["chars"] > b["chars"], a["chars"] == b["chars"]
    for name in ("no_id", "id", "row"):
        ahead |= tied & (a[name] < b[name])
        tied &= a[name] == b[name]
    return ahead


def merge_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sorted run of two sorted runs; of equal digests the better entry stays, with the rows of both."""
    if not len(a) or not len(b):
        return a if len(a) else b
    place = np.searchsorted(a["digest"], b["digest"])
    same = a["digest"][np.minimum(place, len(a) - 1)] == b["digest"]
    ours, theirs = a[place[same]], b[same]
    met = np.where(_better(theirs, ours), theirs, ours)
    met["size"] = ours["size"] + theirs["size"]
    out = a.copy()
    out[place[same]] = met
    return np.insert(out, place[~same], b[~same])


def merge_runs_of(runs: list[np.ndarray]) -> np.ndarray:
    """Many sorted runs as one, merged in pairs, pairs of pairs and so on."""
    while len(runs) > 1:
        runs = [merge_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0] if runs else np.zeros(0, ENTRY)


def _words(run: np.ndarray) -> np.ndarray:
    """The digests as six 64-bit numbers each."""
    return np.ascontiguousarray(run["digest"]).view(">u8").reshape(-1, 6)


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    run = np.zeros(batch.num_rows, ENTRY)
    run["digest"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), "S48")
    ids = batch.column(0)
    run["no_id"] = ids.is_null().to_numpy(zero_copy_only=False)
    run["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
    run["row"] = batch.column(1).to_numpy(zero_copy_only=False)
    run["chars"] = batch.column(2).to_numpy(zero_copy_only=False)
    run["size"] = 1
    return run


def _send(slot: int, run: np.ndarray, level: int, bits: int):
    """The parts of a run with the slots that own the bits of this level."""
    mask = (1 << bits) - 1
    digit = (_words(run)[:, 0].astype(np.uint64) >> np.uint64(64 - bits * (level + 1))).astype(np.int64) & mask
    for x in np.unique(digit):
        part = run[digit == x]
        yield (slot & ~(mask << (bits * level))) | (int(x) << (bits * level)), part.tobytes()


def _runs(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch(
        [pa.array([s for s, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())],
        names=["slot", "run"],
    )


def _winners(run: np.ndarray) -> pa.Table:
    raw = _words(run).tobytes()
    return pa.table(
        {
            "digest": pa.array([raw[i : i + 48] for i in range(0, len(raw), 48)], pa.binary()),
            "keep_id": pa.array(run["id"], mask=run["no_id"] == 1, type=pa.int64()),
            "keep_row": pa.array(run["row"], pa.int64()),
            "group_size": pa.array(run["size"], pa.int64()),
        }
    )


def merge_runs(found: DataFrame, count: int, fan: int = 2, rows_per_slot: int = 16_384) -> DataFrame:
    """One row per distinct digest, after as many rounds as the slots need.

    ``fan`` is a power of two: the number of slots that exchange runs with each other in a round.
    """
    bits = fan.bit_length() - 1
    levels = max(1, -(-(power_of_two(count / rows_per_slot).bit_length() - 1) // bits))
    slots = fan**levels

    def first(batches):
        slot = TaskContext.get().partitionId() % slots
        held = [sorted_run(_entries(b)) for b in batches]
        if held:
            yield _runs(_send(slot, merge_runs_of(held), 0, bits))

    def gathered(table: pa.Table) -> np.ndarray:
        return merge_runs_of([np.frombuffer(r, ENTRY) for r in table.column("run").to_pylist()])

    def step(level):
        def exchange(key, table):
            sent = _send(key[0].as_py(), gathered(table), level, bits)
            return pa.Table.from_batches([_runs(sent)])

        return exchange

    runs = found.mapInArrow(first, RUN_SCHEMA)
    for level in range(1, levels):
        runs = runs.groupBy("slot").applyInArrow(step(level), RUN_SCHEMA)
    return runs.groupBy("slot").applyInArrow(lambda t: _winners(gathered(t)), WIN_SCHEMA)


def exact_dedup(docs: DataFrame, fan: int = 2, rows_per_slot: int = 16_384) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without blanks; a null text counts as empty, and empty
    texts are equal. Of a group the row with the most characters stays, then the smallest doc_id, null
    ids last; of rows repeated under one doc_id exactly one stays. An empty table gives no rows; other
    columns of ``docs`` are not looked at.
    """
    found = pin(digests(docs), "digests")
    won = merge_runs(found, found.count(), fan, rows_per_slot).where("group_size > 1")
    both, lone = found.join(won, "digest", "left"), F.col("group_size").isNull()
    return both.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (lone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, fan: int = 2, rows_per_slot: int = 16_384) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Exactly one row of each group of equal texts stays, also among rows without a doc_id or repeated under one.
    """
    rows = numbered(docs, "exact-rows")
    doc_id, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    plain = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), "row")
    found = pin(digests(plain), "digests")
    won = merge_runs(found, found.count(), fan, rows_per_slot)
    return rows_of(rows, won.select(F.col("keep_row").alias("row")), docs.columns)
