"""Whitening of embeddings by QDWH spectral divide and conquer.

1. Entries become whole numbers; the fit list is each distinct vector once. One pass gives its size and sums, a
   second one the covariance of the centred vectors. Each partition sends one partial sum of each entry of the matrix.
2. The covariance, whose size only the length of a vector decides, is taken apart on the driver: the polar factor of
   the covariance less a shift, by QR-based dynamically weighted Halley steps, gives the projector on the eigenvectors
   above the shift. Bases of both sides make two smaller matrices that are split in turn, until one vector is left.
3. The leading components go to the tasks with the whitening matrix; a pass over the fit list measures how far the
   covariance of the whitened vectors is from the identity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import map_arrow
from panelforge.llm.vectors import clean_vectors, matrix
from panelforge.session import pin

SCALE = 256
#: Rows that are turned into doubles at a time.
TOGETHER = 4096
#: Components with a smaller share of the variance than this have no direction of their own.
NO_VARIANCE = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: the matrix with its eigenvectors and the signs of its eigenvalues."""
    x, eye = a / np.linalg.norm(a), np.eye(len(a))
    least = np.finfo(float).eps / 4  # a lower bound of the singular values that matter
    for _ in range(30):
        square = least * least
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        weight_a = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        weight_b = (weight_a - 1) ** 2 / 4
        weight_c = weight_a + weight_b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(weight_c) * x, eye]))
        upper, lower = q[: len(a)], q[len(a) :]
        new = weight_b / weight_c * x + (weight_a - weight_b / weight_c) / np.sqrt(weight_c) * (upper @ lower.T)
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        least = min(1.0, least * (weight_a + weight_b * square) / (1 + weight_c * square))
        if least > 1 - 1e-12 and moved < 1e-10 * np.sqrt(len(a)):
            break
    return x


def split_subspace(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the invariant subspaces with the larger and the smaller eigenvalues of ``a``.

    The shift is the mean eigenvalue, which always has eigenvalues on both sides unless all are equal; it moves a little
    where it meets an eigenvalue. Equal eigenvalues are split anyhow, as any basis of theirs will do.
    """
    n, eye = len(a), np.eye(len(a))
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * eye)
    if spread <= 1e-15 * max(np.linalg.norm(a), 1e-300):
        return eye[:, : n // 2], eye[:, n // 2 :]
    chance = np.random.default_rng(n)
    for attempt in range(12):
        shift = mean + spread / n * 1e-3 * attempt * (-1) ** attempt
        above = (polar_factor(a - shift * eye) + eye) / 2
        k = round(np.trace(above))
        if 0 < k < n and np.linalg.norm(above @ above - above) < 1e-8:
            break
    k = min(max(k, 1), n - 1)
    bases = []
    for projector, size in ((above, k), (eye - above, n - k)):
        basis, _ = np.linalg.qr(projector @ chance.standard_normal((n, size)))
        basis, _ = np.linalg.qr(projector @ basis)
        bases.append(basis)
    return bases[0], bases[1]


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Only the subspaces that hold them are split further. The largest entry of a vector, the first of equal ones, is
    positive.
    """
    found: list[np.ndarray] = []

    def descend(block: np.ndarray, basis: np.ndarray) -> None:
        if len(found) >= count:
            return
        if len(block) == 1:
            found.append(basis[:, 0])
            return
        for part in split_subspace(block):
            inner = part.T @ block @ part
            descend((inner + inner.T) / 2, basis @ part)

    descend((a + a.T) / 2, np.eye(len(a)))
    vectors = np.stack(found, axis=1)
    vectors /= np.linalg.norm(vectors, axis=0)
    values = np.einsum("ij,ik,kj->j", vectors, a, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    places = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) - 1e-12, axis=0)
    return values, vectors * np.where(vectors[places, range(len(values))] < 0, -1.0, 1.0)


def offsets(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """``x - sums / n`` in doubles, and the sum of squares of ``n * x - sums``, exact; None where no long can hold it."""
    highest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    most = n * highest + max(map(abs, sums))
    if x.shape[1] * most * most < 1 << 63:
        away = n * x - np.array(sums, np.int64)
        return away / n, (away * away).sum(axis=1).tolist()
    away = n * x.astype(object) - np.array(sums, object)
    squares = (away * away).sum(axis=1).tolist()
    return (away / n).astype(np.float64), [s if s < 1 << 63 else None for s in squares]


@dataclass(frozen=True)
class Whitening:
    """``whitened = (x - sums / n) @ matrix``; ``explained`` is each component's share of the variance."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray


def _entry_sums(length: int):
    """Per partition one row for each entry: number of vectors and sum, exact."""

    def run(batches):
        n, sums = 0, [0] * length
        for batch in batches:
            for x in _blocks(batch, 0, length):
                n += len(x)
                exact = x if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object)
                sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.record_batch(
                [
                    pa.array(range(length), pa.int32()),
                    pa.array([n] * length, pa.int64()),
                    pa.array([str(s) for s in sums], pa.string()),
                ],
                names=["i", "n", "total"],
            )

    return run


def _products(length: int, width: int, project):
    """Per partition the upper half of the sum of products of the projected vectors."""
    rows, columns = np.triu_indices(width)

    def run(batches):
        total, any_row = np.zeros((width, width)), False
        for batch in batches:
            for x in _blocks(batch, 0, length):
                y = project(x)
                total += y.T @ y
                any_row = True
        if any_row:
            columns_of = [pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array(total[rows, columns])]
            yield pa.record_batch(columns_of, names=["i", "j", "total"])

    return run


def _blocks(batch: pa.RecordBatch, place: int, length: int):
    for first in range(0, batch.num_rows, TOGETHER):
        yield matrix(batch.column(place).slice(first, TOGETHER), length, np.int64)


def _covariance(fit: DataFrame, length: int, width: int, n: int, project) -> np.ndarray:
    parts = fit.mapInArrow(_products(length, width, project), "i int, j int, total double")
    out = np.zeros((width, width))
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():  # width * width values
        out[r.i, r.j] = out[r.j, r.i] = r.total / n
    return out


def whole_numbers(rows: DataFrame) -> DataFrame:
    """``x``, the entries times ``SCALE`` rounded down, instead of ``embedding``."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    return rows.withColumn("x", x).drop("embedding")


def fit_whitening(fit: DataFrame, length: int, components: int) -> Whitening | None:
    """The whitening of the vectors ``x`` in ``fit``; None if there are none."""
    totals = fit.mapInArrow(_entry_sums(length), "i int, n long, total string")
    totals = totals.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r.i: (r.n, int(r.total)) for r in totals.collect()}  # one row for each entry of a vector
    if not found:
        return None
    n, sums = found[0][0], [found[i][1] for i in range(length)]
    covariance = _covariance(fit, length, length, n, lambda x: offsets(x, n, sums)[0])
    values, vectors = leading_components(covariance, min(components, length))
    total = float(np.trace(covariance))
    real = values > NO_VARIANCE * total
    values, vectors = values[real], vectors[:, real]
    return Whitening(n, sums, vectors / np.sqrt(values), values / total if total else values)


def identity_error(fit: DataFrame, length: int, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity."""
    width = model.matrix.shape[1]
    project = lambda x: offsets(x, model.n, model.sums)[0] @ model.matrix
    return float(np.abs(_covariance(fit, length, width, model.n, project) - np.eye(width)).max(initial=0.0))


def whiten(table: DataFrame, components: int = 4) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or empty or holds a null or non-finite entry go (and those of an odd length, see
    ``clean_vectors``). Repeated rows and null vec_ids give a row each, but the fit list counts equal vectors once.
    Components without variance are left out: a table of one distinct vector, or an empty one, gives no rows.
    ``deviation`` is null where no long can hold it; entries beyond a long become the nearest long. With components of
    equal variance any basis of theirs is given. Other columns are not looked at.
    """
    rows, length = clean_vectors(table)
    spark = table.sparkSession
    if not length:
        return spark.createDataFrame([], SCHEMA)
    fit = pin(whole_numbers(rows).select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, length, components)
    if model is None or not model.matrix.shape[1]:
        return spark.createDataFrame([], SCHEMA)
    error, width = identity_error(fit, length, model), model.matrix.shape[1]

    def run(batch: pa.RecordBatch):
        for first in range(0, batch.num_rows, TOGETHER):
            x = matrix(batch.column(1).slice(first, TOGETHER), length, np.int64)
            away, squares = offsets(x, model.n, model.sums)
            every = np.repeat(np.arange(len(x)), width)
            yield pa.record_batch(
                [
                    batch.column(0).slice(first, TOGETHER).take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(every), model.n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(every)),
                    pa.array((away @ model.matrix).reshape(-1)),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(every), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_arrow(whole_numbers(rows), run, SCHEMA)
