"""Connected components by contraction: a distributed union-find on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import forget_shuffles, pin, unpin

#: After so many rounds the order in which nodes are preferred is drawn anew.
ROUNDS_OF_AN_ORDER = 4


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node in ``edges`` (``a, b`` long): the smallest id it can reach.

    In each round a node hooks to the one of its neighbours and itself that comes first in a hashed order, and the edges
    of the next round are those between what their ends hook to. Neighbourhoods shrink to single nodes, so edges
    become loops and go: few are left after a round, and rounds end with the last. Then the hooks are followed
    backwards. A node with very many neighbours is one minimum with partial aggregation and a skewed key of joins; no
    list of neighbours is built. Loops and repeated edges do no harm, edges with a null end are not looked at; nodes without an edge are not in
    the result, which is written.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    first = pin(ends.distinct(), "edges")  # what makes the edges runs once
    forget_shuffles(first.sparkSession)
    current, hooks = first.where("a > b"), []
    while current.head(1):
        order = F.lit(len(hooks) // ROUNDS_OF_AN_ORDER)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", order)).alias("b"))
        up = F.when(F.xxhash64("a", order) < F.xxhash64("b", order), F.col("a")).otherwise(F.col("b"))
        hooks.append(pin(best.select(F.col("a").alias("id"), up.alias("up")), "hooks"))
        left = hooks[-1].withColumnRenamed("id", "a").withColumnRenamed("up", "x")
        right = hooks[-1].withColumnRenamed("id", "b").withColumnRenamed("up", "y")
        moved = current.join(left, "a").join(right, "b").where("x <> y")
        moved = moved.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        last, current = current if len(hooks) > 1 else None, pin(moved, "edges")
        if last is not None:
            unpin(last)
    loops = first.where("a = b").select(F.col("a").alias("id"), F.col("b").alias("component"))
    if not hooks:
        return loops
    found = hooks[-1].withColumnRenamed("up", "top")
    for hook in hooks[-2::-1]:
        above = found.withColumnRenamed("id", "up")
        found = hook.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("top"))
    if len(hooks) > 1:
        found = pin(found, "tops")
    least = found.groupBy("top").agg(F.min("id").alias("component"))
    named = found.join(least, "top").select("id", "component").unionByName(loops)
    out = pin(named.groupBy("id").agg(F.min("component").alias("component")), "components")
    for frame in (first, current, *hooks, *([found] if len(hooks) > 1 else [])):
        unpin(frame)
    forget_shuffles(out.sparkSession)
    return out
