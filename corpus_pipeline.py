"""The corpus pipeline: documents through five stages, each an operator of
`bibliospark.llm`. Every stage works on all rows its predecessor kept; its
result is written as Parquet and reread as the next one's docs. All stages but
the last return the columns of documents; the last returns the pieces of the
packed sequences (one row each, with their token ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibliospark.llm import line_dedup, packing, quality_rules, simhash, winnowing
from bibliospark.llm.common import materialise
from bibliospark.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the boilerplate lines of
    the others."""
    return quality_rules.strip_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within the edit distance of an earlier one go, and documents that
    are left empty by it."""
    return line_dedup.strip_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, radius=simhash.MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of full windows, neighbours together."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash groups, edit distances and packing are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None
