"""Nearest neighbours with vantage-point trees.

1. Rows are dealt to shards of ``SHARD_ROWS`` to ``LARGEST`` times as many by their place in the table, so that copies of one vector spread.
   Each shard becomes one tree over its distinct vectors: a node has a vantage vector and the near and the far half of
   the rest, each with the least and the largest distance from the vantage. Trees are written once.
2. Query rows are packed in blocks. Every tree meets every block in a unit of its own: a tree holds at most a shard and a
   block at most ``LARGEST`` times ``BLOCK`` queries, so no task gets more than that, and units only become more.
3. In a unit the queries of a block descend together. A half is left out where the triangle inequality says that its
   nearest vector is farther than ``factor`` times the largest distance wanted so far. Factor 1 leaves out nothing
   that is wanted; a smaller one prunes more.
4. Each unit sends the ``k`` nearest of its shard; the nearest of these per query stay.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import releasing
from panelforge.llm.vectors import clean_vectors, matrix
from panelforge.session import pin

SHARD_ROWS, BLOCK, LEAF = 2048, 512, 32
#: Shards and blocks grow to ``LARGEST`` times these sizes while there are at least ``SHARES`` of them: larger ones move
#: fewer bytes for each distance.
LARGEST, SHARES = 16, 256
#: Vantage vectors are the best of so many, judged on so many others.
CANDIDATES, JUDGES = 6, 48
#: Doubles that are held for distances at a time.
TOGETHER = 1 << 21
HIT_SCHEMA = "query long, query_id long, vec_id long, place long, score double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and all of ``b``; squares are added entry by entry."""
    out = np.zeros((len(a), len(b)))
    step = max(1, TOGETHER // max(1, len(b)))
    for i in range(0, len(a), step):
        for left, right in zip(a[i : i + step].T, b.T, strict=True):
            away = left[:, None] - right
            out[i : i + step] += away * away
    return np.sqrt(out, out=out)


def build_tree(vectors: np.ndarray, ids: np.ndarray, no_id: np.ndarray, places: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """The tree of the distinct ``vectors``, as arrays; the rows of equal vectors are listed by falling precedence."""
    order = np.lexsort((places, ids, no_id))
    _, first, group = np.unique(vectors[order], axis=0, return_index=True, return_inverse=True)
    group = group.reshape(-1)
    by_first = np.argsort(first)  # distinct vectors in the order of their best row
    rank = np.empty_like(by_first)
    rank[by_first] = np.arange(len(first))
    rows = np.argsort(rank[group], kind="stable")
    x = vectors[order][first[by_first]]
    ends = np.cumsum(np.bincount(rank[group], minlength=len(x)))
    tree = {"x": x, "ends": ends, "ids": ids[order][rows], "no_id": no_id[order][rows], "places": places[order][rows]}

    chance = np.random.default_rng(seed)
    nodes: list[list[float]] = []  # vantage (-1: a leaf), near and far child or first and end, four distances
    members: list[np.ndarray] = []
    held, todo = 0, [(np.arange(len(x)), -1, 0)]
    while todo:
        mine, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        if len(mine) <= LEAF:
            nodes.append([-1, held, held + len(mine), 0, 0, 0, 0])
            members.append(mine)
            held += len(mine)
            continue
        tried = chance.choice(mine, min(CANDIDATES, len(mine)), replace=False)
        judges = chance.choice(mine, min(JUDGES, len(mine)), replace=False)
        vantage = tried[np.argmax(distances(x[tried], x[judges]).std(axis=1))]
        mine = mine[mine != vantage]
        d = distances(x[vantage][None], x[mine])[0]
        by_distance = np.argsort(d, kind="stable")
        cut = len(mine) // 2
        near, far, d = mine[by_distance[:cut]], mine[by_distance[cut:]], d[by_distance]
        nodes.append([vantage, -1, -1, d[0], d[cut - 1], d[cut], d[-1]])
        todo += [(far, len(nodes) - 1, 2), (near, len(nodes) - 1, 1)]
    table = np.array(nodes, np.float64).reshape(-1, 7)
    tree |= {"nodes": table[:, :3].astype(np.int64), "spans": table[:, 3:]}
    return tree | {"members": np.concatenate(members) if members else np.zeros(0, np.int64)}


class Nearest:
    """The ``k`` nearest vectors of each query so far; of equal distances the smaller index."""

    def __init__(self, queries: int, k: int):
        self.distance = np.full((queries, k), np.inf)
        self.index = np.full((queries, k), -1, np.int64)
        self.reach = np.full(queries, np.inf)

    def offer(self, active: np.ndarray, found: np.ndarray, d: np.ndarray) -> None:
        """Distances ``d`` of the ``active`` queries to the vectors ``found``."""
        row, column = np.nonzero(d <= self.reach[active][:, None])
        if not len(row):
            return
        touched = np.unique(row)
        who = active[touched]
        k = self.index.shape[1]
        query = np.concatenate([np.repeat(touched, k), row])
        distance = np.concatenate([self.distance[who].reshape(-1), d[row, column]])
        index = np.concatenate([self.index[who].reshape(-1), found[column]])
        order = np.lexsort((index, distance, query))
        starts = np.searchsorted(query[order], touched)
        take = order[starts[:, None] + np.arange(k)]
        self.distance[who], self.index[who] = distance[take], index[take]
        self.reach[who] = np.minimum(self.reach[who], self.distance[who, -1])


def search_tree(tree: dict[str, np.ndarray], queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[Nearest, int]:
    """The ``k`` nearest distinct vectors of each query, and how many distances were computed."""
    x, nodes, spans, members = tree["x"], tree["nodes"], tree["spans"], tree["members"]
    best = Nearest(len(queries), k)
    if not len(x) or not len(queries):
        return best, 0
    # down to the leaf that each query would be in: its vectors bound what is wanted
    made, todo = 0, [(0, np.arange(len(queries)))]
    while todo:
        node, active = todo.pop()
        vantage, left, right = nodes[node]
        if vantage < 0:
            d = distances(queries[active], x[members[left:right]])
            if d.shape[1] >= k:
                best.reach[active] = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            d = distances(queries[active], x[vantage][None])[:, 0]
            near = d - spans[node, 1] <= spans[node, 2] - d
            todo += [(n, a) for n, a in ((left, active[near]), (right, active[~near])) if len(a)]
        made += d.size
    todo = [(0, np.arange(len(queries)))]
    while todo:
        node, active = todo.pop()
        vantage, left, right = nodes[node]
        found = members[left:right] if vantage < 0 else np.array([vantage])
        d = distances(queries[active], x[found])
        best.offer(active, found, d)
        made += d.size
        if vantage >= 0:
            d = d[:, 0]
            # computed distances are rounded: what is that close to the limit is looked at
            limit = factor * best.reach[active] + 1e-12 * (d + spans[node, 3])
            for child, low, high in ((right, 2, 3), (left, 0, 1)):
                go = np.maximum(spans[node, low] - d, d - spans[node, high]) <= limit
                if go.any():
                    todo.append((child, active[go]))
    return best, made


def nearest_rows(tree: dict[str, np.ndarray], places: np.ndarray, queries: np.ndarray, k: int, factor: float):
    """``(query, row of the tree, distance)`` of the ``k`` nearest rows of each query, its own place left out."""
    best, _ = search_tree(tree, queries, k + 1, factor)
    query, column = np.nonzero(best.index >= 0)
    vector, d = best.index[query, column], best.distance[query, column]
    ends = tree["ends"]
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    count = np.minimum(ends[vector] - starts[vector], k + 1)  # a row beyond these has k better ones of its own vector
    row = np.repeat(starts[vector] - np.cumsum(count) + count, count) + np.arange(count.sum())
    query, d = np.repeat(query, count), np.repeat(d, count)
    other = tree["places"][row] != places[query]
    query, row, d = query[other], row[other], d[other]
    order = np.lexsort((tree["places"][row], tree["ids"][row], tree["no_id"][row], d, query))
    query, row, d = query[order], row[order], d[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], row[rank < k], d[rank < k]


def _between(least: int, share: int) -> int:
    return min(max(least, share), LARGEST * least)


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as found:
        return {name: found[name] for name in found.files}


def _columns(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = table.column("vec_id").combine_chunks()
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    places = table.column("place").to_numpy().astype(np.int64)
    return matrix(table.column("embedding"), length), ids.fill_null(0).to_numpy(zero_copy_only=False), no_id, places


def build_shards(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """``shard, tree`` of rows ``place, vec_id, embedding``."""

    def build(key, table: pa.Table) -> pa.Table:
        vectors, ids, no_id, places = _columns(table, length)
        shard = key[0].as_py()
        tree = build_tree(vectors, ids, no_id, places, shard)
        return pa.table({"shard": pa.array([shard], pa.int64()), "tree": pa.array([_pack(tree)], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(releasing(build), "shard long, tree binary")


def nearest_neighbours(
    table: DataFrame,
    wanted: str = "vec_id % 100 = 0",
    k: int = 10,
    factor: float = 1.0,
    shard_rows: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found of each row that ``wanted`` (SQL) picks.

    Nearness is the Euclidean distance in double precision, of equal ones the smaller vec_id comes first (null last).
    A row is never its own neighbour, but rows repeated under its vec_id are, and each repeated query row has its own
    neighbours. All rows are found if there are no more than ``k``. With ``factor`` 1 the result is exact. Vectors that
    are null, empty or zero or hold a null or non-finite entry take no part, nor do those of an odd length (see
    ``clean_vectors``). Other columns are not looked at; an empty table has no neighbours.
    """
    clean, length = clean_vectors(table, nonzero=True)
    rows = pin(clean.select(F.monotonically_increasing_id().alias("place"), "vec_id", "embedding"), "vectors")
    count = rows.count()
    shards = max(1, round(count / (shard_rows or _between(SHARD_ROWS, count // SHARES))))
    trees = pin(build_shards(rows, length, shards), "vantage-trees")

    asked = pin(rows.where(wanted), "vector-queries")
    queries = asked.count()
    blocks = max(1, -(-queries // (block or _between(BLOCK, queries // SHARES))))

    def pack(key, table: pa.Table) -> pa.Table:
        vectors, ids, no_id, places = _columns(table, length)
        raw = _pack({"x": vectors, "ids": ids, "no_id": no_id, "places": places})
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "queries": pa.array([raw], pa.binary())})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("place", F.lit(1)), F.lit(blocks)))
    packed = packed.groupBy("block").applyInArrow(releasing(pack), "block long, queries binary")

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        for asked in map(_unpack, queries.column("queries").to_pylist()):
            for tree in map(_unpack, trees.column("tree").to_pylist()):
                query, row, d = nearest_rows(tree, asked["places"], asked["x"], k, factor)
                out.append(
                    {
                        "query": pa.array(asked["places"][query], pa.int64()),
                        "query_id": pa.array(asked["ids"][query], pa.int64(), mask=asked["no_id"][query]),
                        "vec_id": pa.array(tree["ids"][row], pa.int64(), mask=tree["no_id"][row]),
                        "place": pa.array(tree["places"][row], pa.int64()),
                        "score": pa.array(d, pa.float64()),
                    }
                )
        kinds = [("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("place", pa.int64()), ("score", pa.float64())]
        return pa.concat_tables([pa.table(x) for x in out]) if out else pa.schema(kinds).empty_table()

    shard, here = F.col("shard"), F.col("block")
    units = F.sequence(shard * blocks, shard * blocks + blocks - 1)
    left = trees.select("tree", F.explode(units).alias("unit"))
    units = F.sequence(here, here + (shards - 1) * blocks, F.lit(blocks).cast("long"))
    right = packed.select("queries", F.explode(units).alias("unit"))
    hits = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(releasing(search), HIT_SCHEMA)
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "place")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

