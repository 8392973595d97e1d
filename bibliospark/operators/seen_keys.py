"""Incremental id-OR-title dedup (A8, P24): landings are judged against what was
kept before, without a scan of the corpus.

The sequential scan keeps a record unless its id or its title belongs to a kept
one, so a landing only needs the keys of the records kept so far. A store holds,
one partition per landing:

* ``k1``, ``k2`` - the 256-bit hashes of the kept ids and titles, in ``PARTS``
  partitions by their leading bits;
* ``blooms`` - Bloom filters of both in blocks of 32,768 bits, built and merged
  with Spark's bitmap aggregates. All bits of a key lie in one block. When the
  kept keys outgrow the blocks, a landing writes filters of twice as many from
  the key tables, and earlier ones are no longer read;
* ``landings`` - one row per landing with these figures, written last.

A landing's keys meet the filters by a join on the block. Only keys that may have
been seen are looked up, in their parts of the key tables alone. What is left goes
through the rounds of ``greedy_dedup``. So a landing without repeats reads 12 bits
a kept key and next to nothing of the tables; filters decide the work, never the
result.

A landing that fails leaves files that no reader sees and the next one writes
over; of two at once one fails at the end. A hot key (the blank id) is one key to
look up; the joins that drop its records are of checkpointed tables, which AQE splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .dedup import hashed_keys, keep_greedily

#: Bits of a block (that of Spark's bitmaps), bits set per key, and bits held ready for one.
BLOCK_BITS = 32768
PROBES = 5
BITS_PER_KEY = 12
#: Partitions of a landing's key table.
PARTS = 32
SIDES = ("k1", "k2")

_SCHEMAS = {"k1": "key string, part int", "k2": "key string, part int", "blooms": "side string, block long, bits binary",
            "landings": "kept long, blocks long, base int"}


def _part(key: Column) -> Column:
    return (F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % PARTS).alias("part")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks).cast("long")).alias("block")


def _probes(key: Column) -> Column:
    """The places of a key's bits in its block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(2 + k)), F.lit(BLOCK_BITS).cast("long")) for k in range(PROBES)])


def _is_set(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def bloom_of(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the Bloom filter of the rows of (key)."""
    bits = keys.select(_block(F.col("key"), blocks), F.explode(_probes(F.col("key"))).alias("at"))
    return bits.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def may_hold(keys: DataFrame, blooms: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` (key) that the filters (block, bits) may hold."""
    merged = blooms.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = keys.select("key", _block(F.col("key"), blocks)).join(merged, "block")
    return met.where(F.forall(_probes(F.col("key")), lambda at: _is_set(F.col("bits"), at))).select("key")


class SeenKeys:
    """The keys that all landings so far kept, under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ensure_checkpoint_dir(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str, blocks: int = 64) -> SeenKeys:
        """A new, empty store whose filters start with ``blocks`` blocks; fails
        where one stands already."""
        store = cls(spark, path)
        for name in (*SIDES, "blooms"):
            store._write(spark.createDataFrame([], _SCHEMAS[name]), name, 0)
        store._commit(0, Row(kept=0, blocks=blocks, base=0))
        return store

    def _write(self, df: DataFrame, name: str, landing: int) -> None:
        path = f"{self.path}/{name}/landing={landing}"  # over what a failed landing may have left
        if name in SIDES:  # a file per part; keys are hashes, so parts are even
            df.repartition("part").write.mode("overwrite").partitionBy("part").parquet(path)
        else:
            df.write.mode("overwrite").parquet(path)

    def _commit(self, landing: int, row: Row) -> None:
        rows = self.spark.createDataFrame([row], _SCHEMAS["landings"]).coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.path}/landings/landing={landing}")

    def _read(self, name: str) -> DataFrame:
        schema = _SCHEMAS[name].replace(", part int", "") + ", landing int"
        return self.spark.read.schema(schema + (", part int" if name in SIDES else "")).parquet(f"{self.path}/{name}")

    def last(self) -> Row:
        """The last landing: its number, the keys kept so far, the filters' blocks
        and the first landing whose filters count."""
        return self._read("landings").orderBy(F.desc("landing")).first()

    def keys(self, side: str) -> DataFrame:
        """(key, part) of the keys kept so far."""
        return self._read(side).where(F.col("landing") <= self.last()["landing"]).drop("landing")

    def candidates(self, keys: DataFrame, side: str) -> DataFrame:
        """The rows of ``keys`` (key) that the filters of a side may hold."""
        last = self.last()
        blooms = self._read("blooms").where((F.col("side") == side) & F.col("landing").between(last["base"], last["landing"]))
        return may_hold(keys, blooms, last["blocks"])

    def seen(self, keys: DataFrame, side: str) -> DataFrame:
        """The rows of ``keys`` (key, unique) that were kept before."""
        maybe = self.candidates(keys, side).select("key", _part(F.col("key"))).checkpoint()
        parts = [r["part"] for r in maybe.select("part").distinct().collect()]  # PARTS at most
        if not parts:
            return maybe.select("key")
        return maybe.join(self.keys(side).where(F.col("part").isin(parts)), ["part", "key"], "left_semi").select("key")

    def land(self, df: DataFrame, seq: str = "seq", key1: str = "id", key2: str = "title") -> DataFrame:
        """The rows of the landing ``df`` that the scan over all landings in order
        keeps, with all columns; their keys are added to the store. ``seq`` and the
        keys as for ``greedy_dedup``; ``seq`` orders one landing's records."""
        last = self.last()
        n = last["landing"] + 1
        base, rows = hashed_keys(df, seq, key1, key2)
        for side in SIDES:
            known = self.seen(rows.select(F.col(side).alias("key")).distinct(), side).checkpoint()
            rows = rows.join(known.withColumnRenamed("key", side), side, "left_anti").checkpoint()
        kept = keep_greedily(rows).checkpoint()
        total = last["kept"] + kept.count()
        for side in SIDES:
            self._write(kept.select(F.col(side).alias("key"), _part(F.col(side))), side, n)
        blocks, first = last["blocks"], last["base"]
        if total * BITS_PER_KEY > blocks * BLOCK_BITS:  # outgrown: new filters of all keys
            blocks = 2 ** math.ceil(math.log2(2 * total * BITS_PER_KEY / BLOCK_BITS))
            first = n
        filters = [bloom_of(self._read(side).where(F.col("landing").between(n if first < n else 0, n)), blocks)
                   .select(F.lit(side).alias("side"), "block", "bits") for side in SIDES]
        self._write(reduce(DataFrame.unionByName, filters), "blooms", n)
        self._commit(n, Row(kept=total, blocks=blocks, base=first))
        kept = kept.select(F.col("seq").alias("_kept_seq"))
        return base.join(kept, base[seq] == kept["_kept_seq"], "left_semi")
