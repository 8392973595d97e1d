"""Substring search without a scan (P25, T10): trigram posting lists.

Index of (id, text): every position of the lower-cased text starts a trigram (the
last two are padded), and a trigram's posting list holds the ids of the texts it
occurs in, cut into blocks of ``BLOCK`` ids so that no list is one value. Lists lie
sorted by trigram, so a search reads the row groups of its trigrams alone; a small
table holds the length of each list.

Search, for a batch of needles: the lists of a needle's ``LISTS`` rarest trigrams are
intersected, rarest first, and what is left is verified on the texts (joined by id).
A needle of one or two characters takes all lists of trigrams that it starts. Lists
only choose candidates, so hits equal those of ``discussion_search`` for every
needle: case-insensitive, an empty or null needle matches every text, a null text
matches an empty needle alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..session import scratch_path

GRAM = 3
#: Ids of a block of a posting list.
BLOCK = 1 << 16
#: Lists of a needle that are intersected before the texts are read.
LISTS = 4
PAD = "\0"


@dataclass
class SubstringIndex:
    """Paths of the posting lists (gram, block, ids) and of their lengths (gram, n)."""

    spark: SparkSession
    lists: str
    lengths: str

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, block long, ids array<bigint>").parquet(self.lists)

    def counts(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(self.lengths)


def grams(text: Column, pad: bool) -> Column:
    """The distinct trigrams of a lower-cased text; padded, one starts at every
    position."""
    def from_chars(c: Column) -> Column:
        last = F.size(c) - (1 if pad else GRAM)
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        char = lambda i: F.coalesce(F.get(c, i), F.lit(PAD))
        return F.array_distinct(F.transform(at, lambda i: F.concat(char(i), char(i + 1), char(i + 2))))

    lower = F.coalesce(F.lower(text), F.lit(""))
    # one split a text: looking a position up in a string would walk it every time
    chars = F.filter(F.split(lower, ""), lambda c: c != "")
    return F.transform(F.array(chars), from_chars)[0]


def build_index(texts: DataFrame, id_col: str = "id", text_col: str = "question") -> SubstringIndex:
    """The index of ``texts``; ids are unique longs."""
    spark = texts.sparkSession
    index = SubstringIndex(spark, scratch_path(spark, "substring-lists"), scratch_path(spark, "substring-lengths"))
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.explode(grams(F.col(text_col), pad=True)).alias("gram"))
    lists = rows.groupBy("gram", F.expr(f"id div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(index.lists)
    lengths = index.postings().groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    lengths.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(index.lengths)
    return index


def _wanted(index: SubstringIndex, needles: DataFrame, lists: int) -> DataFrame:
    """(nid, rank, gram) of the lists each longer needle reads, rarest first; rank 0
    alone for a needle with a trigram that no text has (no list: no candidate)."""
    asked = needles.select("nid", F.explode(grams(F.col("needle"), pad=False)).alias("gram"))
    # the needles' trigrams are few; their lengths are looked up by pushed-down filters
    counted = asked.join(index.counts(), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("nid").orderBy("n", "gram")
    return counted.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < lists).select("nid", "rank", "gram")


def candidates(index: SubstringIndex, needles: DataFrame, lists: int = LISTS) -> DataFrame:
    """(nid, id) of the texts that may hold each needle (nid unique, needle) of at
    least one character."""
    long = needles.where(F.char_length(F.lower("needle")) >= GRAM)
    wanted = _wanted(index, long, lists).checkpoint()
    names = [r["gram"] for r in wanted.select("gram").distinct().collect()]  # LISTS a needle
    read = index.postings().where(F.col("gram").isin(names)) if names else index.postings().where(F.lit(False))
    found = wanted.where("rank = 0").join(read, "gram").select("nid", F.explode("ids").alias("id"))
    for rank in range(1, lists):
        here = wanted.where(F.col("rank") == rank).select("nid", "gram")
        met = here.join(read, "gram").select("nid", F.explode("ids").alias("id"))
        # needles with fewer trigrams are done
        short = found.join(here.select("nid"), "nid", "left_anti")
        found = found.join(met, ["nid", "id"], "left_semi").unionByName(short)
    few = needles.where(F.char_length(F.lower("needle")) < GRAM)
    starts = [r["s"] for r in few.select(F.lower("needle").alias("s")).distinct().collect()]  # one or two characters each
    if starts:
        opened = F.lit(False)
        for s in starts:
            opened = opened | F.col("gram").startswith(s)
        lists_of = index.postings().where(opened).select(
            "ids", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("s"))
        found = found.unionByName(few.select("nid", F.lower("needle").alias("s")).join(lists_of, "s")
                                  .select("nid", F.explode("ids").alias("id")).distinct())
    return found


def indexed_search(index: SubstringIndex, texts: DataFrame, needles: DataFrame, id_col: str = "id",
                   text_col: str = "question") -> DataFrame:
    """(nid, *columns of texts): the texts that hold each needle (nid, needle)."""
    some = needles.where(F.col("needle") != "")
    found = candidates(index, some).join(some, "nid")
    hits = texts.join(found.withColumnRenamed("id", "_id"), texts[id_col] == F.col("_id")).where(
        F.coalesce(contains_ci(texts[text_col], F.col("needle")), F.lit(False)))
    hits = hits.select("nid", *[texts[c] for c in texts.columns])
    every = needles.where(F.coalesce(F.col("needle") == "", F.lit(True))).select("nid")
    for row in every.collect():  # the answer is the whole table, once a needle
        hits = hits.unionByName(texts.select(F.lit(row["nid"]).cast(needles.schema["nid"].dataType).alias("nid"), "*"))
    return hits
