"""Quality rules on repetition, from a suffix array of each text's words.

The intervals of the longest common prefixes are the repeated word sequences of a text; those that no longer repeat
contains at the same places are maximal. The spans of all maximal repeats of at least ``least_words`` words are
united; a text is rejected if they cover too much of its characters, or if one repeat alone is too long. Suffix arrays are built for many texts at a time, but never across texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import map_arrow, pick, text_parts
from panelforge.llm.exact_dedup import BLANKS
from panelforge.llm.suffixes import covered, longest_repeats, maximal_repeats, suffix_array

SYMBOLS = b"#*$%&|<>"
#: Characters of texts whose suffixes are sorted together.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class RepetitionRules:
    """The limits: fewer words, or more of them in repeated windows, fail the base rules."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Repeats below this number of words do not count as passages.
    least_words: int = 8
    #: The part of the characters of words that repeated passages may cover.
    max_covered: float = 0.4
    #: The part of the words that the longest repeat may have.
    max_longest: float = 0.25


STATS = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "covered_fraction": pa.float64(),
    "longest_repeat": pa.int64(),
    "base_failed": pa.bool_(),
    "kept": pa.bool_(),
}
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_fraction double, longest_repeat long, base_failed boolean, kept boolean"
)


def text_stats(texts: list[str | None], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """The columns of ``STATS`` for a list of texts."""
    n = len(texts)
    out = {name: np.zeros(n, kind.to_pandas_dtype()) for name, kind in STATS.items()}
    ids, codes, sizes = {}, [], []
    chars: list[int] = []
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        codes.extend([ids.setdefault(w, len(ids)) for w in words])
        sizes.append(len(words))
        blanks = len(raw) - len(raw.translate(None, BLANKS))
        out["word_chars"][k] = len(text or "") - blanks
        out["n_symbols"][k] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
    for word in ids:
        chars.append(len(word.decode("utf-8", "surrogatepass")))
    sizes = np.array(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.array(codes, np.int64)
    doc = np.repeat(np.arange(n), sizes)
    suffixes, common = suffix_array(codes, doc, np.repeat(starts[1:], sizes))
    longest = longest_repeats(suffixes, common)
    _, spans = maximal_repeats(codes, doc, suffixes, common, rules.least_words)
    weight = np.array(chars, np.int64)[codes] if len(codes) else codes

    def per_text(values):
        return np.diff(np.concatenate([[0], np.cumsum(values)])[starts])

    window = covered(np.where(longest >= 3, 3, 0), 3)
    passages = covered(spans, rules.least_words)
    out["n_words"] = sizes
    out["n_repeat_words"] = per_text(window)
    some = np.maximum(out["word_chars"], 1)
    out["covered_fraction"] = per_text(weight * passages) / some
    full = np.flatnonzero(sizes)
    if len(full):
        out["longest_repeat"][full] = np.maximum.reduceat(longest, starts[full])
    out["base_failed"] = (sizes < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat_percent * sizes
    )
    passed = (out["covered_fraction"] <= rules.max_covered) & (
        out["longest_repeat"] <= rules.max_longest * sizes
    )
    out["kept"] = ~out["base_failed"] & passed
    return out


def _judge(batch: pa.RecordBatch, rules: RepetitionRules):
    """The batch without its last column, the text, with the statistics of the text behind."""
    column = batch.num_columns - 1
    for first, end, texts in text_parts(batch.column(column), TOGETHER):
        stats = text_stats(texts, rules)
        ahead = [batch.column(i).slice(first, end - first) for i in range(column)]
        columns = ahead + [pa.array(stats[name], kind) for name, kind in STATS.items()]
        yield pa.record_batch(columns, names=[f"c{i}" for i in range(len(columns))])


def quality_rules(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """``doc_id`` and the columns of ``STATS`` for every row.

    A null text has no words, so it fails the base rules, as an empty one does. Repeated rows are judged each; an
    empty table gives no rows; other columns are not looked at.
    """
    rules = rules or RepetitionRules()
    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(plain, lambda b: _judge(b, rules), "doc_id long, " + SCHEMA)


def keep_good(docs: DataFrame, rules: RepetitionRules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; it needs no shuffle."""
    rules = rules or RepetitionRules()
    place = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    kinds = [f.dataType for f in docs.schema.fields]
    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])

    def run(batch: pa.RecordBatch):
        for first, end, texts in text_parts(batch.column(place), TOGETHER):
            stats = text_stats(texts, rules)
            yield batch.slice(first, end - first).filter(pa.array(stats["kept"]))

    return map_arrow(plain, run, schema).toDF(*docs.columns)
