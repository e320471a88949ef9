"""URL rules by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is ``host/path``. It fits its host and all subdomains if the path starts with the rule's. Each URL
is expanded into every expression a rule could have: its host suffixes times its path prefixes of
the lengths that occur among the rules. Expressions meet rules on a short hash prefix; the full
digest confirms; the longest rule wins and, of one rule with both actions, ``block``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import pick

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hexadecimal digits of the digest on which expressions and rules are joined.
SHORT = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``action, rule`` from a short list; longer lists are read from a table."""
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "\\'") for x in r)) for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(action, rule)")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url``).

    A null or unsplittable URL has an empty host and path. Without a fitting rule ``rule`` is null and
    the verdict ``default``. Repeated rows are all kept; rules that are null or lack a host or a slash
    are left out; without rules or pages the result is complete or empty. Other columns are not looked at.
    """
    rules = pick(rules, "action", "rule").where(F.col("rule").contains("/"))
    parts = rules.select(
        "action",
        "rule",
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"),
    ).where("rule_host <> ''")
    # one row: the path lengths of the rules, which the length of a URL bounds
    shape = parts.agg(
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
    ).first()
    seen = pick(pages, "page_id", "url")
    seen = seen.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shape.lengths:
        return seen.select(
            "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    digest = F.sha2("rule", 256)
    known = (
        parts.groupBy("rule")
        .agg(F.max("action").alias("action"))  # "block" sorts after "allow"
        .withColumn("digest", digest)
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    labels = F.split("host", r"\.")
    count = F.least(F.size(labels), F.lit(shape.labels))
    suffixes = F.transform(
        F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(labels, -k, k), ".")
    )
    lengths = F.array(*(F.lit(n) for n in sorted(shape.lengths)))
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    distinct = seen.select("host", "path").where("host <> '' AND path <> ''").distinct()
    expressions = (
        distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
        .select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .select("host", "path", F.concat("suffix", "prefix").alias("expression"))
        .withColumn("full", F.sha2("expression", 256))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    fits = expressions.join(known, "short").where("full = digest")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best")
    )
    return seen.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
