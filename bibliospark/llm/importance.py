"""Operator 7, quality classifier: importance resampling.

Two generative models over hashed word uni- and bigrams, one of the target text
(documents labelled as good and not toxic) and one of the raw text (all
documents), are bags of ``BUCKETS`` bucket probabilities. A document's weight is
the log ratio of its probability under both models. Sampling without
replacement by these weights takes the k largest keys log ratio + Gumbel noise;
the noise comes from a hash of the row, so a rerun selects the same rows.

Plan: one pass counts buckets in each task (a vector of fixed size per model),
one pass scores; the ids of the target documents, at most ``TARGETS``, are
broadcast, so no text is shuffled. The k-th largest key is found by counting keys in 4,096 bins of
the remaining range, round by round, so nothing is sorted or collected but bin
counts. Every document is counted and scored; k is the sampling operator's
feature.

Defined cases: null text and text without words have no n-grams and a null
ratio; they are never selected. Equal rows share their noise and are selected
together, so at ties of the k-th key more than k rows may be selected. Without
target documents the target model is uniform. A document in `labels` more than
once is a target document if one of its rows says so.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, whole_text

BUCKETS = 16_384
#: Target documents the target model is learned from: a bounded sample of the
#: labelled rows, taken by hash where there are more. The raw model counts all.
TARGETS = 2_000_000
#: Share of the documents with words that is drawn.
SHARE = 0.85
_BINS = 4096


def ngram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text, A-Z lower-cased."""
    words = text.encode().lower().split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
    return (np.concatenate((h, pairs)) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), counted over all documents."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(
        F.col("doc_id").alias("good")).distinct()
    good = materialise(good, "targets")
    n = good.count()
    if n > TARGETS:  # about TARGETS of them, by a hash of the id
        good = good.where(F.pmod(F.xxhash64("good"), F.lit(1 << 30)) < F.lit((TARGETS << 30) // n))
    # at most about TARGETS ids of 8 bytes
    rows = docs.join(F.broadcast(good), docs["doc_id"] == good["good"], "left").select(
        whole_text(docs["text"]).alias("text"), F.col("good").isNotNull().alias("target"))

    def count(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = np.bincount(ngram_buckets(text, buckets), minlength=buckets)
                total[0] += n
                if target:
                    total[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])],
                                         ["bucket", "raw", "target"])

    counted = (rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket")
               .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())  # `buckets` rows
    raw, target = np.ones(buckets), np.ones(buckets)
    at = counted["bucket"].to_numpy(np.int64)
    raw[at] += counted["raw"]
    target[at] += counted["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest non-null `key`, or None if there are fewer: each round
    counts the keys of a range in bins and goes on in the bin that holds it."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or n < k:
        return None
    while low < high:
        width = (high - low) / _BINS
        if low + width <= low:  # neighbouring numbers: count them as they are
            rows = keys.where(F.col("key").between(low, high)).groupBy("key").count().orderBy(F.desc("key")).collect()
            for key, c in rows:
                if k <= c:
                    return key
                k -= c
        at = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1))
        rows = (keys.where(F.col("key").between(low, high)).groupBy(at.alias("bin"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"))
                .orderBy(F.desc("bin")).collect())  # at most _BINS rows
        for r in rows:
            if k <= r["c"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["c"]
    return high


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ngrams, log_ratio, key (with
    Gumbel noise), selected."""
    small_batches(docs.sparkSession)
    ratio = models(docs, labels, buckets)

    def score(batches):
        for b in batches:
            ids, h, texts = [c.to_pylist() for c in b.columns]
            n, weight, key = [], [], []
            for x, text in zip(h, texts):
                at = ngram_buckets(text, buckets)
                n.append(len(at))
                w = float(ratio[at].sum()) if len(at) else None
                u = ((x % (1 << 64) >> 12) + 0.5) / (1 << 52)
                weight.append(w)
                key.append(None if w is None else w - float(np.log(-np.log(u))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(key, pa.float64())],
                ["doc_id", "n_ngrams", "log_ratio", "key"])

    text = whole_text("text")
    scored = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.lit("gumbel"), "doc_id", text).alias("h"),
                         text.alias("text")).mapInArrow(score, "doc_id long, n_ngrams long, log_ratio double, key double")
    scored = materialise(scored, "scored")
    with_words = scored.agg(F.count("key")).first()[0]
    least = kth_largest(scored, round(with_words * share))
    picked = F.lit(False) if least is None else F.coalesce(F.col("key") >= F.lit(least), F.lit(False))
    return scored.withColumn("selected", picked)
