"""Helpers the operators share: shared-folder tables, words, components."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: The white space of `[^\x20\x09-\x0D]+`, and ASCII letters.
WHITE_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Everything that separates the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of an Arrow batch handed to Python; whole texts may be long.
BATCH_ROWS = 256


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back:
    computed once, cut from its lineage, safe if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of one Arrow batch; a runtime setting of the session. The
    same for all operators: executors keep separate Python daemons and idle
    workers for each value."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def whole_text(col: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` in order."""
    return F.array_remove(F.split(text, r"[ \t-\r]+"), "")


def alnum_words(text: Column) -> Column:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), NOT_ALNUM), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable
    is not inlined where it is used, a projected expression may be)."""
    return F.transform(F.array(value), body)[0]


class Dealer:
    """Packed records (rows of unsigned 64-bit words) dealt over buckets.

    A task holds back at most ``HELD`` bytes, then hands on one blob per bucket,
    so a record costs its bytes in the shuffle and nothing a row."""

    HELD = 32 << 20
    SCHEMA = "bucket int, records binary"

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [[] for _ in range(buckets)], 0

    def add(self, records: np.ndarray, keys: np.ndarray) -> None:
        """Deal by the upper bits of the keys."""
        if not len(records):
            return
        to = (keys >> np.uint64(33)) % np.uint64(self.buckets)
        order = np.argsort(to, kind="stable")
        records, to = records[order], to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        for k, part in zip(to[np.concatenate(([0], cuts))].tolist(), np.split(records, cuts)):
            self.held[k].append(part.tobytes())
        self.size += records.nbytes

    def full(self):
        if self.size >= self.HELD:
            yield from self.rest()

    def rest(self):
        at = [k for k, parts in enumerate(self.held) if parts]
        if at:
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([b"".join(self.held[k]) for k in at], pa.binary())],
                ["bucket", "records"])
        self.held, self.size = [[] for _ in range(self.buckets)], 0

    @staticmethod
    def read(table: pa.Table, words: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, np.uint64).reshape(-1, words) for x in table["records"].to_pylist()])


def buckets_for(docs: DataFrame, per_partition: int) -> int:
    """Buckets for records whose number follows the size of an input partition."""
    return max(8, per_partition * docs.rdd.getNumPartitions())


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which null equals null."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the connected components of undirected ``edges``, root
    the smallest node; only nodes with an edge to another node appear.

    Alternating large-star and small-star rounds: every round replaces each
    node's links by links to the smallest neighbour, so a hub never lists its
    pairs. The rounds are tables in the shared folder. Ends when a round
    changes nothing (O(log n) rounds in practice); no cap on rounds.
    """
    links = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v").distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), "lows")
        # large star: neighbours above u move to u's smallest neighbour
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = materialise(large, "large")
        # small star: u's neighbours below it, and u, move to the smallest of them
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        joined = large.join(low, "u")
        links = materialise(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)).alias("n"),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
