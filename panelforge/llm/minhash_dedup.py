"""Near duplicates by b-bit MinHash.

1. Each text's shingles give ``ROWS * BANDS`` minima. Of each minimum only the lowest bit is kept, packed into
   one signature; hashes of ``ROWS`` minima are the band keys. Texts with the same shingles are one class.
2. Classes meet in the buckets of equal band keys. There the signatures alone estimate the similarity: two
   signatures agree in a share ``p`` of their bits, half of which agreement is chance, so it is ``2 p - 1``.
   What may be similar is joined into clusters, as members of a star and never as all pairs.
3. The members of a cluster are compared on their full shingle sets, and the confirmed links give the
   components.

A bucket or cluster beyond ``BLOCK`` members is dealt to blocks, and every pair of blocks is a unit of work of its
own; nothing is dropped, and no task holds more than two blocks of one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import map_arrow, marked, numbered, pick, releasing, rows_of, text_parts
from panelforge.llm.components import connected_components
from panelforge.session import pin

#: A pair misses all bands with a chance of 1e-6 at a similarity of 0.85 and 2e-4 at 0.8.
ROWS, BANDS = 7, 36
HASHES = ROWS * BANDS
#: Estimates may be so much below a true similarity: of a pair that meets in a band 2e-7 have more differing bits at
#: 0.85 (42 are let through) and 2e-6 at 0.8 (48), less than the bands miss.
ESTIMATE_SLACK = 0.185
SIGNATURE_BLOCK, SET_BLOCK = 1024, 1024
TOGETHER = 1 << 19
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240229)
FLIPS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SIG_SCHEMA = "row long, doc_id long, n_shingles long, class binary, bits binary, bands binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``size`` words.

    A-Z are lower-cased; a text with fewer words is one shingle, one without words has none.
    """
    ids: dict[bytes, int] = {}
    codes, sizes = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        codes.extend([ids.setdefault(w, len(ids)) for w in words])
        sizes.append(len(words))
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ids], np.uint64)
    words = hashes[np.array(codes, np.int64)] if codes else np.zeros(0, np.uint64)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(size):
        n = len(words) - k
        if n > 0:
            rolled[:n] = mix(rolled[:n] * MIX + words[k:])
    out, at = [], 0
    for n in sizes:
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            whole = np.uint64(n)
            for w in words[at : at + n]:
                whole = mix(np.array([whole]) * MIX + w)[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` minima for each of the sets, none of which is empty."""
    low = np.concatenate(sets).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        x = (low ^ FLIPS[i]) * FACTORS[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, (len(least), BANDS)).copy()
    banded = least.reshape(-1, BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = mix(keys * MIX + banded[:, :, j])
    return keys.astype(np.int64)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """``SIG_SCHEMA`` of ``row, doc_id, text``."""

    def run(batch: pa.RecordBatch):
        for first, end, texts in text_parts(batch.column(2), TOGETHER):
            sets = shingle_sets(texts, size)
            full = [k for k, s in enumerate(sets) if len(s)]
            bits, bands, names = ([None] * len(sets) for _ in range(3))
            if full:
                least = minima([sets[k] for k in full])
                packed = np.packbits((least & 1).astype(np.uint8), axis=1)
                for k, b, keys in zip(full, packed, band_keys(least), strict=True):
                    names[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                    bits[k], bands[k] = b.tobytes(), keys.tobytes()
            yield pa.record_batch(
                [
                    *(batch.column(i).slice(first, end - first) for i in (0, 1)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array(x, pa.binary()) for x in (names, bits, bands)),
                ],
                names=["row", "doc_id", "n_shingles", "class", "bits", "bands"],
            )

    return map_arrow(rows, run, SIG_SCHEMA)


def components_of(near: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches in a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n, dtype=np.int32)
    near = near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], np.int32(n)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_components(near: np.ndarray) -> np.ndarray:
    """``components_of`` for many matrices of one size."""
    size = near.shape[-1]
    near = near | np.eye(size, dtype=bool)
    label = np.broadcast_to(np.arange(size, dtype=np.int32), near.shape[:2])
    while True:
        new = np.where(near, label[:, None, :], np.int32(size)).min(axis=2)
        new = np.take_along_axis(new, new.astype(np.int64), axis=1)
        if (new == label).all():
            return label
        label = new


def bits_apart(bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of each pair of signatures (rows of words), on the last two axes."""
    apart = np.zeros((*bits.shape[:-1], others.shape[-2]), np.int16)
    for w in range(bits.shape[-1]):
        apart += np.bitwise_count(bits[..., :, w, None] ^ others[..., None, :, w])
    return apart


def block_components(bits: np.ndarray, most_apart: float, block: int = 256) -> np.ndarray:
    """``components_of`` for many signatures, a block of rows at a time."""
    label = np.arange(len(bits), dtype=np.int32)
    while True:
        new = label.copy()
        for lo in range(0, len(bits), block):
            near = bits_apart(bits[lo : lo + block], bits) <= most_apart
            new[lo : lo + block] = np.where(near, new[None, :], np.int32(len(bits))).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bucket_roots(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray, most_apart: float) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` sorted by key and id, and for each the place of the first one that it is joined with within its key.

    Signatures with up to ``most_apart`` differing bits may be similar; buckets of one size are compared together.
    """
    order = np.lexsort((ids, keys))
    keys, ids, bits = keys[order], ids[order], bits[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(keys)]]))
    root = np.arange(len(keys))
    for size in np.unique(sizes[sizes > 1]):
        starts = first[sizes == size]
        step = max(1, (1 << 18) // int(size * size))
        for k in range(0, len(starts), step):
            places = starts[k : k + step, None] + np.arange(size)[None, :]
            if size > 512:
                labels = block_components(bits[places[0]], most_apart)[None, :]
            elif size == 2:
                near = bits_apart(bits[places[:, :1]], bits[places[:, 1:]])[:, 0, 0] <= most_apart
                labels = np.stack([np.zeros(len(near), np.int64), 1 - near.astype(np.int64)], axis=1)
            else:
                near = bits_apart(bits[places], bits[places]) <= most_apart
                labels = group_components(near)
            root[places] = np.take_along_axis(places, labels.astype(np.int64), axis=1)
    return ids, root


def bucket_stars(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray, most_apart: float):
    """``(members, roots)``: stars of what may be similar within each bucket of equal keys."""
    ids, root = bucket_roots(keys, ids, bits, most_apart)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return [ids[moved]], [ids[root[moved]]]


def similar_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets have ``100 * common >= percent * union``, exactly.

    Only hashes that two sets share matter; they become the columns of incidence matrices.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    width = 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo == hi:
            continue
        part = np.zeros((n, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - k * width] = 1
        common += part @ part.T
    near = np.empty((n, n), bool)
    for lo in range(0, n, 256):
        rows = common[lo : lo + 256].astype(np.float64)
        union = sizes[lo : lo + 256, None] + sizes[None, :] - rows
        near[lo : lo + 256] = 100 * rows >= percent * union
    np.fill_diagonal(near, False)
    return near


def block_units(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """``rows`` of groups with two members or more, with the array ``units``: each names what is compared together.

    A group of up to ``block`` members is one unit; a larger one has a unit for each pair of its blocks.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    blocks = F.ceil(F.col("n_members") / block).cast("int")
    mine = F.pmod(F.xxhash64(member), blocks).cast("int")
    partners = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda other: F.xxhash64(group, F.least(F.col("mine"), other), F.greatest(F.col("mine"), other)),
    )
    return (
        rows.join(counts, group)
        .withColumn("mine", mine)
        .withColumn("units", F.when(F.col("n_members") <= block, F.array(F.xxhash64(group))).otherwise(partners))
        .drop("mine", "n_members")
    )


def in_blocks(rows: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """``block_units``, with a row for each ``unit``."""
    return block_units(rows, group, member, block).withColumn("unit", F.explode("units")).drop("units")


def stars(rows: DataFrame, bins: int, fn: Callable[[pa.Table], tuple[list, list]]) -> DataFrame:
    """``a, b``: the members and roots that ``fn`` finds in each bin of units."""

    def run(table):
        members, roots = fn(table)
        empty = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *members]), "b": np.concatenate([empty, *roots])})

    binned = rows.withColumn("bin", F.pmod(F.xxhash64("unit", F.lit("bin")), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(releasing(run), "a long, b long")


def _fixed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1) if raw else np.zeros((0, 4), kind)


def _signature_stars(lowest: float):
    def run(table: pa.Table):
        bits = _fixed(table.column("bits"), "<u8")
        most = HASHES * (1 - lowest) / 2  # half of the bits that are not alike agree by chance
        return bucket_stars(table.column("unit").to_numpy(), table.column("id").to_numpy(), bits, most)

    return run


def set_stars(percent: int, read: Callable[[list], list[np.ndarray]]):
    """Stars of what is similar in each unit; ``read`` makes sets of the values in column ``content``."""

    def run(table: pa.Table):
        units, ids = table.column("unit").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, units))
        cuts = np.flatnonzero(np.concatenate([[True], units[order][1:] != units[order][:-1], [True]]))
        content, members, roots = table.column("content"), [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            place = order[lo:hi]
            mine = ids[place]
            label = components_of(similar_matrix(read([content[int(p)].as_py() for p in place]), percent))
            moved = np.flatnonzero(label != np.arange(len(place)))
            members.append(mine[moved])
            roots.append(mine[label[moved]])
        return members, roots

    return run


def _as_sets(raws: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint64) for r in raws]


def near_rows(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``row, doc_id, n_shingles, first`` of ``row, doc_id, text``, which have been written with their numbers.

    ``first`` is the ``no_id, doc_id, row`` of the row that comes first among those that links reach: by doc_id (null
    last), then row.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    signed = pin(signatures(rows, size), "signatures")
    solid = signed.where("class IS NOT NULL")
    classes = solid.groupBy("class").agg(F.min(place).alias("first"))
    classes = pin(classes.withColumn("id", F.col("first.row")), "classes")
    reps = marked(solid.select("row", "bits", "bands"), classes.select(F.col("id").alias("row")))
    reps = pin(reps.withColumnRenamed("row", "id"), "representatives")
    count = reps.count()

    words = F.array(*(F.substring("bands", 8 * i + 1, 8) for i in range(BANDS)))
    buckets = reps.select("id", F.explode(words).alias("key"))
    buckets = buckets.select("id", F.xxhash64("key").alias("key"))
    dealt = in_blocks(buckets, "key", "id", SIGNATURE_BLOCK)
    dealt = dealt.select("id", "unit").join(reps.select("id", "bits"), "id")
    bins = max(1, count // 2048)
    clusters = connected_components(stars(dealt, bins, _signature_stars(percent / 100 - ESTIMATE_SLACK)))
    clusters = clusters.withColumnRenamed("component", "cluster")

    def full_sets(batch: pa.RecordBatch):
        for first, end, texts in text_parts(batch.column(1), TOGETHER):
            raw = [s.tobytes() for s in shingle_sets(texts, size)]
            columns = [*(batch.column(i).slice(first, end - first) for i in (0, 2)), pa.array(raw, pa.binary())]
            yield pa.record_batch(columns, names=["id", "units", "content"])

    # texts meet their units before sets are made, which are larger and so are shuffled only once
    texts = marked(rows.select("row", "text"), clusters.select(F.col("id").alias("row"))).withColumnRenamed("row", "id")
    units = block_units(clusters, "cluster", "id", SET_BLOCK).select("id", "units")
    sets = map_arrow(texts.join(units, "id").select("id", "text", "units"), full_sets, "id long, units array<long>, content binary")
    sets = sets.select("id", F.explode("units").alias("unit"), "content")
    linked = stars(sets, bins, set_stars(percent, _as_sets))
    components = connected_components(linked)

    joined = classes.join(components, "id", "left")
    firsts = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("its_first"))
    of_class = joined.join(firsts, "component", "left").select("class", F.coalesce("its_first", "first").alias("first"))
    out = signed.select("row", "doc_id", "n_shingles", "class").join(of_class, "class", "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("first", place).alias("first"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Texts are linked when their sets of ``size``-word shingles have a Jaccard similarity of ``percent`` / 100 or
    more (at least 80); ``component_id`` is the smallest doc_id that links reach, null if no row there has one.
    Rows with that doc_id are kept, and the first row of a component without doc_ids. Empty and null texts have no
    shingles and are linked with nothing. Each row has its own links, also among rows repeated under one doc_id. Other
    columns are not looked at; an empty table gives no rows.
    """
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = numbered(docs, "near-rows").toDF("doc_id", "text", "row").select("row", "doc_id", "text")
    component = F.col("first.doc_id")
    return near_rows(rows, size, percent).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("row") == F.col("first.row")).alias("kept"),
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their component: exactly one of each.

    First is the smallest doc_id (null last); of rows repeated under it, or without one, any one stays.
    """
    rows = numbered(docs, "near-rows")
    doc_id, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    plain = rows.select("row", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = near_rows(plain, size, percent)
    return rows_of(rows, found.where(F.col("row") == F.col("first.row")), docs.columns)
