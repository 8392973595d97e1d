"""Boolean keyword search on bitmaps.

Index of (id, keyword string): ids are cut into buckets of 32,768, those of Spark's
bitmaps, and a keyword has one container a bucket: the sorted positions while there
are at most ``SPARSE``, else a bitmap. A group of the build is one keyword in one
bucket, so it holds 32,768 positions at most however frequent the keyword is.
Containers lie sorted by keyword; a search reads the row groups of its keywords.

A batch of queries is a table (qid, clause, negated, keyword): the keywords of a
clause are alternatives, an article must meet all clauses that are not negated and
none that is. Bitmaps are merged by ``bitmap_or_agg`` within a clause and by
``bitmap_and_agg`` over clauses; no article is read.

Defined cases: keywords are split, stripped and lower-cased as ``keyword_bag`` does,
those of queries are stripped and lower-cased; a null or empty one stands in no
article. A query of negated clauses alone selects from all indexed articles, those
without keywords included. Repeated ids are one article with the keywords of all its
rows; null ids are not indexed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import scratch_path

#: Positions up to which a container is a list; from there a bitmap is smaller.
SPARSE = 1024
#: Fixed values of Spark's bitmaps: positions of a bucket, bytes of a bitmap.
POSITIONS, BYTES = 32_768, 4_096

_BUCKET = "keyword string, bucket long, "


@dataclass
class KeywordIndex:
    """Paths of the containers, as lists and as bitmaps, and of the bitmaps of all ids."""

    spark: SparkSession
    lists: str
    bitmaps: str
    all_ids: str

    def sparse(self) -> DataFrame:
        return self.spark.read.schema(_BUCKET + "positions array<int>").parquet(self.lists)

    def dense(self) -> DataFrame:
        return self.spark.read.schema(_BUCKET + "bits binary").parquet(self.bitmaps)

    def everything(self) -> DataFrame:
        return self.spark.read.schema("bucket long, bits binary").parquet(self.all_ids)


def build_index(articles: DataFrame, delimiter: str = ";", id_col: str = "id", keyword_col: str = "mots_cles",
                sparse: int = SPARSE) -> KeywordIndex:
    """The index of ``articles``."""
    spark = articles.sparkSession
    index = KeywordIndex(spark, *(scratch_path(spark, "keyword-" + x) for x in ("lists", "bitmaps", "ids")))
    rows = articles.where(F.col(id_col).isNotNull()).select(
        F.bitmap_bucket_number(F.col(id_col).cast("long")).alias("bucket"),
        F.bitmap_bit_position(F.col(id_col).cast("long")).cast("int").alias("at"),
        F.array_distinct(F.split(F.coalesce(F.col(keyword_col), F.lit("")), re.escape(delimiter))).alias("keywords"))
    rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).write.parquet(index.all_ids)

    groups = scratch_path(spark, "keyword-groups")
    # stripped and lower-cased row by row, as ``split_tokens`` does within a list:
    # expressions over rows are compiled, those within lists are not
    (rows.select("bucket", "at", F.explode("keywords").alias("keyword"))
     .withColumn("keyword", F.lower(py_strip("keyword"))).where("keyword <> ''").groupBy("keyword", "bucket")
     .agg(F.sort_array(F.collect_set("at")).alias("positions")).write.parquet(groups))
    made = spark.read.schema(_BUCKET + "positions array<int>").parquet(groups)
    few = F.size("positions") <= sparse

    def write(containers: DataFrame, path: str) -> None:
        containers.repartitionByRange("keyword", "bucket").sortWithinPartitions("keyword", "bucket").write.parquet(path)

    write(made.where(few), index.lists)
    write(made.where(~few).select("keyword", "bucket", F.explode("positions").alias("at"))
          .groupBy("keyword", "bucket").agg(F.bitmap_construct_agg("at").alias("bits")), index.bitmaps)
    return index


def _ids(bucket: Column, bits: str, without: str) -> Column:
    """The ids of the set bits of a bucket that are not set in ``without`` (may be null)."""
    byte = "CAST(conv(hex(substring({}, i + 1, 1)), 16, 10) AS INT)"
    left = f"{byte.format(bits)} & ~coalesce({byte.format(without)}, 0)"
    held = f"filter(transform(sequence(0, {BYTES - 1}), i -> struct(i, {left} AS v)), s -> s.v <> 0)"
    at = F.expr(f"flatten(transform({held}, s -> transform(filter(sequence(0, 7), b -> (shiftright(s.v, b) & 1) = 1), "
                "b -> s.i * 8 + b)))")
    # buckets from 1 on hold positive ids, the others zero and below
    return F.transform(at, lambda p: F.when(bucket > 0, (bucket - 1) * POSITIONS + p + 1).otherwise(bucket * POSITIONS - p))


def search(index: KeywordIndex, queries: DataFrame) -> DataFrame:
    """(qid, id) of the articles that each query (qid, clause, negated, keyword) selects."""
    # all negated clauses of a query are one set to take away
    asked = queries.select("qid", F.when(~F.col("negated"), F.col("clause").cast("long")).alias("clause"), "negated",
                           F.lower(py_strip(F.col("keyword"))).alias("keyword")).distinct().checkpoint()
    names = [r["keyword"] for r in asked.select("keyword").distinct().collect()]  # the batch's own words
    part = ["qid", "clause", "negated", "bucket"]

    def read(containers: DataFrame) -> DataFrame:
        return containers.where(F.col("keyword").isin([n for n in names if n])).join(asked, "keyword")

    sets = (read(index.sparse()).select(*part, F.explode("positions").alias("at"))
            .groupBy(*part).agg(F.bitmap_construct_agg("at").alias("bits"))
            .unionByName(read(index.dense()).select(*part, "bits"))
            .groupBy(*part).agg(F.bitmap_or_agg("bits").alias("bits")).checkpoint())
    clauses = asked.groupBy("qid").agg(F.count_distinct("clause").alias("clauses"))
    met = (sets.where(~F.col("negated")).groupBy("qid", "bucket")
           .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
           .join(clauses, "qid").where("n = clauses").select("qid", "bucket", "bits"))
    open_ = [r["qid"] for r in clauses.where("clauses = 0").collect()]  # negated clauses alone
    if open_:
        kind = queries.schema["qid"].dataType
        met = met.unionByName(index.everything().select(
            F.explode(F.array(*[F.lit(q).cast(kind) for q in open_])).alias("qid"), "bucket", "bits"))
    gone = sets.where("negated").select("qid", "bucket", F.col("bits").alias("without"))
    return met.join(gone, ["qid", "bucket"], "left").select(
        "qid", F.explode(_ids(F.col("bucket"), "bits", "without")).alias("id"))
