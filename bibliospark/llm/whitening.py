"""Operator 12, embedding whitening: pivoted Cholesky of the centred scatter,
then one-sided Jacobi directly on the triangular factor.

Entries become integers, so the number of vectors and the sums per dimension
are exact, and every centred entry ``(n * x - S) / n`` is rounded once. Passes
over the vectors, each a scan without a shuffle of rows: count and sums, scatter,
covariance of the whitened vectors, result. A task hands on one matrix of
dimensions x dimensions; matrices are added in tasks before the last few reach
the driver, so what it holds depends on the dimensions alone.

The scatter over n is V = L L' with L from Cholesky with the largest remaining
diagonal entry as pivot; it ends where that entry is rounding (``RANK``), which
finds the rank. Rotations from the right make the columns of L orthogonal: then
V = (L J)(L J)', the squared norms of the columns are the eigenvalues, and the
columns over their norms the components.

Defined cases: a null vector or one with null, NaN or infinite entries is
dropped, and so is one whose length is not the most frequent one (ties: the
longest) or that is empty; repeated rows and null vec_ids count and are returned
like others; entries beyond the range are held at +-2^52. Components are
returned as far as the rank goes (none where all vectors are equal, so one row
has no result); a deviation beyond a long is null; an empty table has no rows.
Signs: the largest entry of a component is positive. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Largest magnitude of an integer entry: exact as double.
HELD = 2.0 ** 52
#: A remaining diagonal entry below this share of the largest one is rounding.
RANK = 1e-12
SWEEPS = 60


# ------------------------------------------------------------------ linear --

def pivoted_cholesky(v: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """L (d x rank) with v = L L'; rows in the order of v's, so L is triangular
    up to the permutation of its pivots. Pivots below ``tolerance`` of the largest
    diagonal entry are rounding; by default v's entries are taken as exact doubles."""
    rest, out = np.array(v, np.float64), []
    if tolerance is None:
        tolerance = len(rest) * np.finfo(np.float64).eps
    limit = tolerance * max(rest.diagonal().max(initial=0.0), 0.0)
    for _ in range(len(rest)):
        at = int(rest.diagonal().argmax())
        pivot = rest[at, at]
        if pivot <= limit:
            break
        column = rest[:, at] / math.sqrt(pivot)
        out.append(column)
        rest -= np.outer(column, column)
        rest[at, :] = rest[:, at] = 0.0  # exactly eliminated
    return np.stack(out, axis=1) if out else np.zeros((len(rest), 0))


def _rounds(k: int):
    """Pairs (i, j) of all columns in rounds of disjoint pairs (a tournament)."""
    ring = list(range(k + k % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1]) if max(a, b) < k]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of L L' by rotating
    pairs of columns of L until all are orthogonal."""
    a = np.array(factor, np.float64)
    k = a.shape[1]
    for _ in range(SWEEPS if k > 1 else 0):
        worst = 0.0
        for i, j in _rounds(k):
            x, y = a[:, i], a[:, j]
            p, q, r = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(p * q)
            cosine = np.divide(np.abs(r), size, out=np.zeros_like(r), where=size > 0)
            worst = max(worst, float(cosine.max(initial=0.0)))
            turn = cosine > 1e-16
            zeta = np.divide(q - p, 2 * r, out=np.zeros_like(r), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = np.where(turn, c * t, 0.0)
            c = np.where(turn, c, 1.0)
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
        if worst < 1e-15:
            break
    values = (a * a).sum(0)
    order = np.argsort(-values, kind="stable")
    vectors = a[:, order] / np.sqrt(values[order])
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values[order], vectors


# ------------------------------------------------------------------- passes --

def integers(vectors: np.ndarray) -> np.ndarray:
    """x = floor(64 * c) + 1000000 of entries as double."""
    return np.clip(np.floor(SCALE * vectors), -HELD, HELD).astype(np.int64) + SHIFT


def _usable(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0), np.int64)


def _total(partials: DataFrame, width: int) -> np.ndarray:
    """The sum of the arrays of doubles (column ``part``) that the tasks made, added in
    about the square root of their number of tasks first."""
    def add(batches):
        total = np.zeros(width)
        for b in batches:
            for part in b.column(0).to_pylist():
                total += np.frombuffer(part, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    tasks = partials.rdd.getNumPartitions()
    rows = partials.repartition(max(1, math.isqrt(tasks))).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r["part"], np.float64) for r in rows), np.zeros(width))


def sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their integers."""
    def add(batches):
        n, total = 0, [0] * dim
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                small = abs(x).max() < (1 << 62) // len(x)
                part = x.sum(0) if small else x.astype(object).sum(0)
                n, total = n + len(x), [a + int(p) for a, p in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(dim)], pa.int32()), pa.array([str(n), *map(str, total)])], ["at", "value"])

    parts = vectors.select("v").mapInArrow(add, "at int, value string")
    rows = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found = {r["at"]: int(r["value"]) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dim)]


def _exact(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, in Python integers where a long is too short."""
    largest = int(abs(x).max(initial=0))
    if n * largest + max(map(abs, total)) < 1 << 63:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (_exact(x, n, total) / n).astype(np.float64)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    d = _exact(x, n, total)
    if d.dtype != object and float(abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0 ** 62:
        return (d * d).sum(1).tolist()
    d = d.astype(object)
    return [int(s) if s < 1 << 63 else None for s in (d * d).sum(1)]


def _scatter(vectors: DataFrame, dim: int, values) -> tuple[np.ndarray, np.ndarray]:
    """Sum, and sum of outer products, of ``values(x)`` over all vectors."""
    def add(batches):
        first, second = np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                y = values(_matrix(b.column(0)))
                first += y.sum(0)
                second += y.T @ y
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], ["part"])

    both = _total(vectors.select("v").mapInArrow(add, "part binary"), dim + dim * dim)
    return both[:dim], both[dim:].reshape(dim, dim)


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component."""
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = _usable(embeddings)
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    length = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if length is None:
        return spark.createDataFrame([], RESULT)
    dim = int(length["dim"])
    vectors = vectors.where(F.size("v") == dim)
    n, total = sums(vectors, dim)
    first, second = _scatter(vectors, dim, lambda x: _centred(x, n, total))
    v = second / n
    values, axes = one_sided_jacobi(pivoted_cholesky((v + v.T) / 2, RANK))
    k = min(components, len(values))
    if not k:
        return spark.createDataFrame([], RESULT)
    project = axes[:, :k] / np.sqrt(values[:k])
    middle = (first / n) @ project  # what rounding leaves of the centre
    _, cov = _scatter(vectors, k, lambda x: _centred(x, n, total) @ project - middle)
    error = float(abs(cov / n - np.eye(k)).max())
    share = (values[:k] / v.trace()).tolist()

    def rows(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                w = _centred(x, n, total) @ project
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(_deviations(x, n, total), pa.int64()),
                     pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())],
                    ["vec_id", "deviation", "w"])

    out = vectors.mapInArrow(rows, "vec_id long, deviation long, w array<double>").select(
        "vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.array(*[F.lit(s) for s in share])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      "whitened", F.get(explained, F.col("at")).alias("explained"),
                      F.lit(error).alias("identity_error"))
