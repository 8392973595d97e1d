"""Parquet scans of the landed tables.

Every read goes through ``spark.read.parquet`` so Catalyst can prune columns and
push filters into the scan; callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


class Catalog:
    """Lazy accessor: ``Catalog(spark, dir).orders`` is a DataFrame scan."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.base, name)
        raise AttributeError(name)
