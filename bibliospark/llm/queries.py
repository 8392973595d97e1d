"""The thin `opN_<name>` queries: each reads its whole table, calls its
operator with production parameters and returns the full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import (importance, license_scan, line_dedup, merkle, minhash, packing, quality_rules, repeats, simhash,
               url_filter, warc, whitening, winnowing)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.query(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(spark, table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.query(table(spark, sf_dir, "documents"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_url_filter, op3_repeats, op4_simhash_dedup, op5_warc, op6_line_dedup,
        op7_importance_resampling, op8_decontamination, op9_packing, op10_license_scan, op11_merkle_manifest,
        op12_embedding_whitening, op13_minhash_dedup)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express; tests/llm compares the
    others with brute force."""
    return {"op1_quality_rules": quality_rules.SQL, "op5_warc": warc.SQL, "op8_decontamination": winnowing.SQL,
            "op10_license_scan": license_scan.SQL, "op11_merkle_manifest": merkle.SQL}
