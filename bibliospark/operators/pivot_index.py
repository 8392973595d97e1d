"""Exact k nearest neighbours through a pivot index (J9): the triangle
inequality leaves vectors out unseen.

Index: pivots are drawn from the corpus by a hash of the id (their number grows
with the root of the corpus, bounded by ``MAX_PIVOTS``). Every vector lies in the
Voronoi cell of its nearest pivot; a table in the shared folder holds a partition
per cell with the distance ``r`` of each vector to its pivot, and the driver the
pivots with count, smallest and largest ``r`` of their cells.

Search, per batch of questions (bounded by bytes; batches follow each other, and
each one's candidates are written before the next one is broadcast):

1. a question visits its nearest cells until they hold k vectors; the k-th
   distance found there bounds its true k-th distance;
2. it visits each further cell that may hold a nearer vector. A cell is left out
   by its ring (``d(q, p) - r_max`` or ``r_min - d(q, p)`` beyond the bound) or by
   the half space of its pivot (``(d(q, p)^2 - d(q, p0)^2) / 2 d(p, p0)``), a
   vector within a visited cell by ``|d(q, p) - r|``.

Only the partitions of visited cells are read, in place: no vector is shuffled,
and tasks hand on their k best per question. A cell that holds a third of the
corpus is many files and row groups, so many tasks. The result equals
``exact_knn`` whatever the pivots; they decide the work alone, which is returned
as the number of vectors compared per question.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .retrieval import CAND_SCHEMA, TopK, question_batches

MAX_PIVOTS = 256
#: Slack of a bound for the rounding of distances, as a share of the largest one.
SLACK = 1e-9


@dataclass
class PivotIndex:
    """The pivots with their cells' rings, and the table of the cells."""

    path: str
    pivots: np.ndarray
    count: np.ndarray
    r_min: np.ndarray
    r_max: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of a and b, from differences (no cancellation)."""
    return np.stack([np.sqrt(np.einsum("ad,ad->a", a - y, a - y)) for y in b], axis=1) if len(b) else \
        np.zeros((len(a), 0))


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def build_index(corpus: DataFrame, pivots: int | None = None) -> PivotIndex:
    """The index of ``corpus`` (article_id long, embedding array<float>); rows
    without a vector are nobody's neighbours and left out."""
    spark = corpus.sparkSession
    corpus = corpus.where(F.col("embedding").isNotNull()).select("article_id", "embedding")
    if pivots is None:
        pivots = min(MAX_PIVOTS, math.isqrt(corpus.count()) + 1)
    drawn = corpus.orderBy(F.xxhash64("article_id"), "article_id").limit(min(pivots, MAX_PIVOTS)).collect()
    centre = np.unique(np.array([r["embedding"] for r in drawn], np.float64), axis=0) if drawn else np.zeros((0, 0))
    path = scratch_path(spark, "pivot-index")

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(_rows(b.column(1), b.num_rows), centre)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])],
                    ["article_id", "embedding", "cell", "r"])

    kind = corpus.schema["embedding"].dataType.simpleString()
    cells = corpus.mapInArrow(assign, f"article_id long, embedding {kind}, cell int, r double")
    # ranges of (cell, r): a large cell is cut over tasks, a small one is one file,
    # and the statistics of row groups follow r
    cells.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.partitionBy("cell").parquet(path)
    size = len(centre)
    count, r_min, r_max = np.zeros(size, np.int64), np.full(size, np.inf), np.full(size, -np.inf)
    if size:
        table = _cells(spark, path, kind)
        for row in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"),
                                             F.max("r").alias("b")).collect():  # one row per pivot
            count[row["cell"]], r_min[row["cell"]], r_max[row["cell"]] = row["n"], row["a"], row["b"]
    return PivotIndex(path, centre, count, r_min, r_max)


def _cells(spark, path: str, kind: str = "array<float>") -> DataFrame:
    return spark.read.schema(f"article_id long, embedding {kind}, r double, cell int").parquet(path)


def _visit(spark, index: PivotIndex, qids, Q, near, wanted, bound, k) -> DataFrame:
    """Candidates (qid, article_id, distance, compared) of the questions in the
    cells that ``wanted`` (questions x cells) marks; ``bound`` holds a distance per
    question beyond which a vector is of no use. A task adds a row per question
    with the number of vectors it compared."""
    cells = np.flatnonzero(wanted.any(axis=0))
    shared = spark.sparkContext.broadcast((qids, Q, near, wanted, bound))

    def scan(batches):
        qids_, Q_, near_, wanted_, bound_ = shared.value
        best = TopK(Q_, k, limit=bound_ ** 2 * (1 + 1e-9))
        compared = np.zeros(len(Q_), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            C, ids = _rows(b.column(1), b.num_rows), b.column(0).to_numpy(zero_copy_only=False)
            r, cell = b.column(2).to_numpy(), b.column(3).to_numpy()
            for c in np.unique(cell):
                at, asking = np.flatnonzero(cell == c), np.flatnonzero(wanted_[:, c])
                # by distance to the pivot: what a question has to see is a range of it
                at = at[np.argsort(r[at], kind="stable")]
                low = np.searchsorted(r[at], near_[asking, c] - bound_[asking], "left")
                high = np.searchsorted(r[at], near_[asking, c] + bound_[asking], "right")
                compared[asking] += high - low
                rows = high > low
                if rows.any():
                    at = at[low[rows].min():high[rows].max()]
                    best.add_some(asking[rows], C[at], ids[at])
        found = best.result(qids_)
        some = np.flatnonzero(compared)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([found["qid"].to_numpy(), qids_[some]]), pa.int64()),
             pa.array(found["article_id"].tolist() + [None] * len(some), pa.int64()),
             pa.array(found["distance"].tolist() + [None] * len(some), pa.float64()),
             pa.array([None] * len(found) + compared[some].tolist(), pa.int64())],
            ["qid", "article_id", "distance", "compared"])

    rows = _cells(spark, index.path).where(F.col("cell").isin(cells.tolist())).select("article_id", "embedding", "r", "cell")
    path = scratch_path(spark, "pivot-candidates")
    schema = f"{CAND_SCHEMA}, compared long"
    rows.mapInArrow(scan, schema).write.parquet(path)
    shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _ranked(candidates: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("distance", "article_id")
    return (candidates.where(F.col("article_id").isNotNull()).withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k).select("qid", "rank", "article_id", "distance"))


def pivot_knn(index: PivotIndex, queries: DataFrame, k: int, batch_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The k nearest corpus rows (qid, rank, article_id, distance) of every
    question (qid long, embedding), as ``exact_knn`` returns them, and the work
    (qid, compared, total). Question ids are unique."""
    spark = queries.sparkSession
    parts = []
    # a question takes its vector, a distance and a mark per cell
    for batch in question_batches(queries, ["qid", "embedding"], batch_bytes, extra=12 * len(index.pivots)):
        qids = batch["qid"].to_numpy(np.int64)
        if not len(qids) or not len(index.pivots):
            continue
        Q = np.array(batch["embedding"].tolist(), np.float64)
        near = _distances(Q, index.pivots)
        order = near.argsort(axis=1, kind="stable")
        before = np.cumsum(index.count[order], axis=1) - index.count[order]
        first = np.zeros(near.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        found = _visit(spark, index, qids, Q, near, first, np.full(len(qids), np.inf), k)
        bound = np.full(len(qids), np.inf)
        place = {q: i for i, q in enumerate(qids.tolist())}
        for row in _ranked(found, k).where(F.col("rank") == k).select("qid", "distance").collect():
            bound[place[row["qid"]]] = math.sqrt(row["distance"])
        slack = SLACK * (1 + near.max(axis=1))
        bound += slack
        ring = np.maximum(near - index.r_max, index.r_min - near)
        own = order[:, 0]
        between = _distances(index.pivots, index.pivots)[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            half = (near ** 2 - near[np.arange(len(own)), own][:, None] ** 2) / (2 * between)
        least = np.maximum(ring, np.where(between > 1e-6 * (1 + near), half, 0.0))
        more = (least <= (bound + slack)[:, None]) & ~first & (index.count > 0)
        parts.append(found)
        if more.any():
            parts.append(_visit(spark, index, qids, Q, near, more, bound, k))
    if not parts:
        empty = spark.createDataFrame([], f"{CAND_SCHEMA}, compared long")
        parts = [empty]
    candidates = reduce(DataFrame.unionByName, parts)
    work = candidates.where(F.col("compared").isNotNull()).groupBy("qid").agg(F.sum("compared").alias("compared"))
    return _ranked(candidates, k), work.withColumn("total", F.lit(int(index.count.sum())).cast("long"))
