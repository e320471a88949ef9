"""Mixing sources to target weights, in DataFrame functions only.

Documents hang in a tree domain / language / source. A token budget is handed down level by level:
siblings share their parent's budget by weight, none gets more than its capacity (its tokens times
``max_epochs``), and what one cannot use goes to its siblings; only what all of them cannot use is
missing one level up, where that node's siblings take it. Each leaf then fills its share from seeded
epochs: whole passes over its documents, then the prefix of one more pass in seeded order.

The order within a leaf is never sorted in one task: seeded digests deal its documents to about
the root of their number of buckets, bucket sums find the one bucket where the share ends, and only
that bucket is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import WORD, pick
from panelforge.session import pin

LEVELS = ("domain", "lang", "source")


def word_count(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_domain(source: Column) -> Column:
    """``d0`` ... ``d3`` by the number that ends a source's name, ``d-`` without a number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("d-")).otherwise(
        F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))
    )


def node_weight(weights: dict[str, dict[str, float]], level: str) -> Column:
    """The weight of a node by its name, 1 if it has none."""
    column = F.lit(1.0)
    for name, weight in weights.get(level, {}).items():
        column = F.when(F.col(level) == name, F.lit(float(weight))).otherwise(column)
    return column


def seeded_key(seed: str, epoch: Column, doc_id: Column) -> Column:
    """The digest that orders the documents of a leaf in one epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``given``: each node's part of ``budget`` among the siblings of one parent.

    ``nodes`` has ``weight, capacity, budget``. In order of capacity per weight the nodes are full as long as
    their capacity is below their part of what is left; the others share the rest by weight.
    """
    order = W.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*parents)
    placed = (
        nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0)))
        .withColumn("onward", F.sum("weight").over(onward))
        .withColumn("full", F.col("capacity") * F.col("onward") <= F.col("weight") * F.col("left"))
    )
    # it falls from the first node that is not full onward
    rate = F.max(F.when(~F.col("full"), F.col("left") / F.col("onward"))).over(whole)
    return (
        placed.withColumn("rate", rate)
        .withColumn("given", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.col("rate")))
        .drop("left", "onward", "full", "rate")
    )


def leaf_budgets(
    leaves: DataFrame, weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int
) -> DataFrame:
    """``domain, lang, source, supply, n_docs, budget`` from ``..., supply, n_docs``.

    The whole budget is ``budget_share`` of all tokens. Nodes of weight 0 get nothing.
    """
    table = leaves
    for level in LEVELS:
        table = table.withColumn(f"w_{level}", node_weight(weights, level))
    alive = F.lit(True)
    for level in LEVELS:
        alive = alive & (F.col(f"w_{level}") > 0)
    table = table.withColumn("room", F.when(alive, F.col("supply") * max_epochs).otherwise(0).cast("double"))
    total = leaves.agg(F.floor(F.sum("supply") * budget_share + F.lit(1e-6)).cast("double").alias("budget"))
    parents: list[str] = []
    given = None
    for level in LEVELS:
        keys = [*parents, level]
        nodes = table.where(f"w_{level} > 0").groupBy(*keys).agg(
            F.max(f"w_{level}").alias("weight"), F.sum("room").alias("capacity")
        )
        nodes = nodes.where("capacity > 0")
        if given is None:
            # a sum of one row; every node of the first level reads it
            nodes = nodes.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").drop("one")
            shared = share(nodes.withColumn("root", F.lit(0)), ["root"], level).drop("root")
        else:
            shared = share(nodes.join(given, parents), parents, level)
        given = shared.select(*keys, F.col("given").alias("budget"))
        parents = keys
    kept = given.withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))
    return leaves.join(kept, list(LEVELS)).where("budget > 0")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, dict[str, float]],
    budget_share: float,
    max_epochs: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """One row per chosen document and epoch.

    ``doc_id, domain, lang, source, epoch, n_tokens, taken_tokens``: ``taken_tokens`` is below
    ``n_tokens`` only for the document in which a leaf's share ends. Tokens are words. Null languages and sources
    count as empty names, null texts as empty; documents without words are never chosen. Rows
    repeated under one doc_id are separate documents next to each other in seeded order. A budget beyond the
    capacity of all leaves takes all of them; an empty table gives no rows.
    """
    rows = pick(docs, "doc_id", "text", "lang", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_domain(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        word_count(F.col("text")).alias("n_tokens"),
    )
    rows = pin(rows.where("n_tokens > 0"), "mix-rows")
    leaves = rows.groupBy(*LEVELS).agg(
        F.sum("n_tokens").alias("supply"), F.count(F.lit(1)).alias("n_docs")
    )
    # a row per leaf; written, so that its measured size decides whether joins broadcast it
    plan = leaf_budgets(leaves, weights, budget_share, max_epochs)
    plan = plan.withColumn("passes", F.floor(F.col("budget") / F.col("supply")).cast("int"))
    plan = pin(plan.withColumn("rest", F.col("budget") - F.col("passes") * F.col("supply")), "mix-plan")

    both = rows.join(plan.select(*LEVELS, "n_docs", "passes", "rest"), list(LEVELS))
    whole = both.where("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    whole = whole.withColumn("taken_tokens", F.col("n_tokens"))

    key = seeded_key(seed, F.col("passes"), F.col("doc_id"))
    spread = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.sqrt("n_docs")).cast("long")
    last = both.where("rest > 0").withColumn("key", key)
    last = last.withColumn("bucket", F.floor(spread * buckets / F.lit(float(2**32))).cast("long"))
    sums = last.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"))
    ahead = W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0).cast("long")))
    last = last.join(sums, [*LEVELS, "bucket"]).where("ahead < rest")
    inside = last.where("ahead + held <= rest").withColumn("taken_tokens", F.col("n_tokens"))
    running = W.partitionBy(*LEVELS, "bucket").orderBy("key", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    cut = last.where("ahead + held > rest").withColumn(
        "place", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0))
    )
    cut = cut.where("place < rest").withColumn(
        "taken_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("place"))
    )
    columns = ["doc_id", *LEVELS, "epoch", "n_tokens", "taken_tokens"]
    part = inside.drop("held", "ahead").unionByName(cut.drop("held", "ahead", "place"))
    return whole.select(columns).unionByName(part.withColumn("epoch", F.col("passes")).select(columns))


def keep_mixture(
    docs: DataFrame, weights: dict[str, dict[str, float]], budget_share: float, seed: str = "mix"
) -> DataFrame:
    """The rows of ``docs`` that ``mix_sources`` takes within one epoch, whole and with all their columns.

    A leaf's choice is everything up to its last document in seeded order, so one row per leaf says
    it, and the texts are not shuffled. Rows repeated under one doc_id with as many words share their fate.
    """
    chosen = mix_sources(docs, weights, budget_share, max_epochs=1, seed=seed)
    order = F.struct(seeded_key(seed, F.lit(0), F.col("doc_id")).alias("key"), "n_tokens")
    last = pin(chosen.groupBy(*LEVELS).agg(F.max(order).alias("last")), "mix-last")

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, text, lang, source = (F.col(f"c{docs.columns.index(n)}") for n in ("doc_id", "text", "lang", "source"))
    named = plain.withColumns(
        {"domain": source_domain(source), "lang": F.coalesce(lang, F.lit("")), "source": F.coalesce(source, F.lit(""))}
    )
    key = seeded_key(seed, F.lit(0), doc_id.cast("long"))
    tied = (key == F.col("last.key")) & (word_count(text) <= F.col("last.n_tokens"))
    kept = named.join(last, list(LEVELS)).where(((key < F.col("last.key")) | tied) & text.rlike(WORD))
    return kept.select(*plain.columns).toDF(*docs.columns)
