"""A quality classifier by regularised quadratic discriminant analysis.

Statistics of each text (shares of symbols, capitals, repeats and the like) are transformed to be nearer to normal.
Each class has a mean and a covariance, shrunk towards the diagonal of the pooled one, which are sums
over all labelled rows in one aggregation. A score is the logistic of the difference of the two
log densities, each a squared Mahalanobis distance through the class's cached Cholesky factor.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import map_arrow, pick, text_parts
from panelforge.llm.exact_dedup import BLANKS, TOGETHER
from panelforge.session import pin

CAPITALS = bytes(range(65, 91))
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = (
    "length", "word_length", "line_length", "symbols", "pipes", "exclamations", "capitals", "digits", "stops",
    "letters", "distinct", "most_frequent", "next_equal", "repeated_lines",
)
#: Documents with this remainder of crc32(doc_id) mod 4 are never learned from.
HELD_OUT = 2


def text_statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text: logarithms of sizes, arcsine roots of shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw.translate(None, BLANKS)))

    def share_of(characters):
        return (len(raw) - len(raw.translate(None, characters))) / size

    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    counts = Counter(words)
    shares = [
        share_of(b"#*$%&<>@=~^_{}\\"),
        share_of(b"|"),
        share_of(b"!"),
        share_of(CAPITALS),
        share_of(b"0123456789"),
        share_of(b".,;:?"),
        share_of(LETTERS),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
    ]
    sizes = [np.log1p(len(words)), np.log(size / n), np.log1p(len(words) / max(1, len(lines)))]
    return [float(x) for x in sizes] + np.arcsin(np.sqrt(np.clip(shares, 0, 1))).tolist()


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one double per name in ``FEATURES``; a null text counts as empty."""

    def run(batch: pa.RecordBatch):
        parts = text_parts(batch.column(1), TOGETHER)
        rows = np.array([text_statistics(t) for part in parts for t in part[2]], np.float64)
        rows = rows.reshape(-1, len(FEATURES))
        columns = [batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))]
        yield pa.record_batch(columns, names=["doc_id", *FEATURES])

    plain = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(plain, run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; a null id has no labels and is not."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % 4 == HELD_OUT, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Per class, 0 and 1: mean, inverse Cholesky factor, and log of prior over root determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        logs = [
            self.offsets[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(axis=1)
            for c in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.1, floor: float = 1e-4) -> Discriminant | None:
    """The discriminant of rows with ``FEATURES`` and ``label`` (0 or 1); None if a class is missing.

    All rows count; two rows of sums, whose number of columns the features fix, reach the driver.
    """
    k = len(FEATURES)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count(F.lit(1)).alias("n")]
    sums += [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in labelled.groupBy("label").agg(*sums).collect()}
    if not {0, 1} <= set(rows):
        return None
    counts = np.array([rows[c]["n"] for c in (0, 1)], float)
    means = np.array([[rows[c][f"s{i}"] / rows[c]["n"] for i in range(k)] for c in (0, 1)])
    own = np.zeros((2, k, k))
    for c in (0, 1):
        for i, j in pairs:
            own[c, i, j] = own[c, j, i] = rows[c][f"p{i}_{j}"] / counts[c] - means[c, i] * means[c, j]
    pooled = np.tensordot(counts / counts.sum(), own, 1)
    target = np.diag(np.maximum(np.diag(pooled), 0) + floor)
    lower = [np.linalg.cholesky((1 - shrink) * own[c] + shrink * target + floor * np.eye(k)) for c in (0, 1)]
    logs = np.log(counts / counts.sum()) - np.array([np.log(np.diag(low)).sum() for low in lower])
    return Discriminant(means, np.array([np.linalg.inv(low) for low in lower]), logs)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The labels (``doc_id, quality``) of documents that are not held out are learned, all of them; other values than 0
    and 1 and null ids are not. Without labels of both classes every score is 0.5. Scores read
    the text alone. Null texts count as empty; repeated rows are scored each; other columns are not looked at.
    """
    found = pin(statistics(docs), "statistics")
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))
    model = fit(found.join(known, "doc_id"))

    def run(batch: pa.RecordBatch):
        x = np.stack([batch.column(i).to_numpy() for i in range(1, len(FEATURES) + 1)], axis=1)
        scores = model.scores(x) if model else np.full(len(x), 0.5)
        yield pa.record_batch([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    scored = map_arrow(found, run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
