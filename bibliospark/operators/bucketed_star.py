"""A bucketed star: bridges and dimensions that join without an exchange (K2,
S4, J2-J5).

Every table is written once in buckets of the key it is joined by, sorted in
each, and one file a bucket. Reports then read a bridge and its dimension
bucket by bucket: no row of either moves. A bridge that is joined by two keys
is stored once per key.

A key that holds many rows of a bridge would make one bucket, and so one task,
as large. Keys of more rows than an average bucket are stored apart, in no
buckets; there are at most as many of them as buckets, so the dimension rows
they meet are broadcast, and the hot rows are read by any number of tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (key of the bridge, dimension, key of the dimension) per stored bridge.
LINKS = {
    "article_auteur": ("auteur_id", "auteurs", "id"),
    "auteur_affiliation": ("affiliation_id", "affiliations", "id"),
}


class BucketedStar:
    """Tables under ``path``; ``prefix`` names them in the session's catalog, which
    is where Spark keeps that a table is bucketed. ``buckets`` is the number that
    they were written with; another session opens the store with the same."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, prefix: str):
        self.spark, self.path, self.buckets, self.prefix = spark, path.rstrip("/"), buckets, prefix

    # ------------------------------------------------------------ writing --

    def write(self, dimensions: dict[str, DataFrame], bridges: dict[str, DataFrame]) -> "BucketedStar":
        """Write the dimensions and bridges that ``LINKS`` names; rows of a
        bridge with a null key join nothing and are kept with the cold ones."""
        for bridge, (key, dim, dim_key) in LINKS.items():
            if bridge in bridges:
                self._write_bucketed(dim, dimensions[dim], dim_key)
                self._write_bridge(bridge, bridges[bridge], key)
                # an empty table may have no file to tell its columns
                kept = [(n, self.table(n).schema.json()) for n in (dim, bridge)]
                (self.spark.createDataFrame(kept, "name string, schema string").coalesce(1)
                 .write.mode("overwrite").parquet(f"{self.path}/{bridge}_schemas"))
        return self

    def _write_bucketed(self, name: str, df: DataFrame, key: str) -> None:
        (df.repartition(self.buckets, key).write.mode("overwrite").option("path", f"{self.path}/{name}")
         .bucketBy(self.buckets, key).sortBy(key).saveAsTable(self._table(name)))

    def _write_bridge(self, name: str, df: DataFrame, key: str) -> None:
        sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        limit = df.count() / self.buckets
        # fewer than `buckets` keys: each holds over a bucket's share of the rows
        hot = F.broadcast(sizes.where(F.col("_n") > limit).select(F.col(key).alias("_hot")))
        marked = df.join(hot, F.col(key) == F.col("_hot"), "left")
        self._write_bucketed(name, marked.where(F.col("_hot").isNull()).drop("_hot"), key)
        marked.where(F.col("_hot").isNotNull()).drop("_hot").write.mode("overwrite").parquet(f"{self.path}/{name}_hot")

    def attach(self) -> "BucketedStar":
        """Name the tables of a written store in this session's catalog."""
        for bridge, (key, dim, dim_key) in LINKS.items():
            kept = {r.name: r.schema for r in self.spark.read.parquet(f"{self.path}/{bridge}_schemas").collect()}
            for name, by in ((dim, dim_key), (bridge, key)):
                schema = StructType.fromJson(json.loads(kept[name]))
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
                self.spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {self._table(name)} ({columns}) USING parquet "
                    f"CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {self.buckets} BUCKETS "
                    f"LOCATION '{self.path}/{name}'")
        return self

    def _table(self, name: str) -> str:
        return f"{self.prefix}_{name}"

    # ------------------------------------------------------------ reading --

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def cold(self, bridge: str) -> DataFrame:
        """The bucketed rows of a bridge with their dimension row; no exchange."""
        key, dim, dim_key = LINKS[bridge]
        d = self.table(dim).withColumnRenamed(dim_key, key)
        return self.table(bridge).join(d.hint("merge"), key)

    def hot(self, bridge: str) -> DataFrame:
        """The rows of hot keys with their dimension row."""
        key, dim, dim_key = LINKS[bridge]
        rows = self.spark.read.schema(self.table(bridge).schema).parquet(f"{self.path}/{bridge}_hot")
        d = self.table(dim).withColumnRenamed(dim_key, key)
        held = d.join(F.broadcast(rows.select(key).distinct()), key, "left_semi")
        return rows.join(F.broadcast(held), key)

    def joined(self, bridge: str) -> DataFrame:
        """Every bridge row with its dimension row, a bag."""
        return self.cold(bridge).unionByName(self.hot(bridge))

    def mentions(self, bridge: str, label: str) -> DataFrame:
        """(label, n): bridge rows per value of the dimension's column ``label``.
        Counted per key in the bucket, then once more per label."""
        key, dim, dim_key = LINKS[bridge]
        per_key = self.table(bridge).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        d = self.table(dim).select(F.col(dim_key).alias(key), label)
        cold = per_key.join(d.hint("merge"), key).select(label, "n")
        hot = self.hot(bridge).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        return cold.unionByName(hot).groupBy(label).agg(F.sum("n").alias("n"))
