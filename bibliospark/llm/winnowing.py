"""Operator 8, benchmark decontamination [native]: winnowing.

Of every window of six consecutive 5-gram hashes (ten words) the smallest is
kept. Two texts that share ten words share such a window, so they keep the
same hash: the join of kept fingerprints misses no shared span. Documents with
a joined fingerprint are read again; every 5-gram of theirs that meets a
benchmark fingerprint is extended word by word to both sides, and runs of ten
equal words or more are hits. An item of fewer than ten words is one window:
its whole word sequence is its fingerprint, one pass per length that occurs.

Plan: hashes and minima are array expressions inside a row. The benchmark's
fingerprints are broadcast when their counted number is under
``BROADCAST_ROWS``, else both sides are joined by hash with a shuffle. Only
(document, fingerprint) keys that match leave the first pass; texts are joined
to nothing but the keys of matching documents. A passage that many documents
share costs one row a document and fingerprint, never a pair of documents.

Defined cases: null text or item has no words; a null item_id occurs but is
not listed; equal items count once by their ids; equal rows give equal rows.
Runs are compared word by word, so a hash collision is no hit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, let, materialise, same, whole_text

K = 5           # words hashed together
WINDOW = 6      # hashes a kept one is the smallest of
SPAN = K + WINDOW - 1  # ten words: shared spans of this length are found
#: Rows of 8-byte hashes that may be broadcast (32 MB); beyond it, a shuffle join.
BROADCAST_ROWS = 4_000_000


def _grams(words: Column, n: int) -> Column:
    """Hash of every run of n words, by its place."""
    hashed = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + o) for o in range(1, n)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))


def _kept(grams: Column) -> Column:
    """The smallest hash of every window, each once."""
    def lowest(g):
        return F.array_distinct(F.transform(
            F.slice(g, F.lit(1), F.greatest(F.size(g) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.least(x, *[F.get(g, i + o) for o in range(1, WINDOW)])))
    return let(grams, lowest)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(whole_text("text")).alias("text_hash"),
                       alnum_words(whole_text("text")).alias("words"))


def _places(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """One row per run of n words: place, hash, the SPAN words from it and, nearest
    first, the WINDOW - 1 before it."""
    def context(w):
        return F.transform(_grams(w, n), lambda h, i: F.struct(
            h.alias("hash"), F.slice(w, i + 1, F.lit(SPAN)).alias("ahead"),
            F.reverse(F.slice(w, F.greatest(i - (WINDOW - 1), F.lit(0)) + 1,
                              F.least(i, F.lit(WINDOW - 1)))).alias("behind")))
    return (rows.select(*keep, F.posexplode(let(F.col("words"), context)).alias("place", "c"))
            .select(*keep, "place", "c.*"))


def _run(a: str, b: str, n: int) -> Column:
    """How many of the first n words of two lists agree before one differs."""
    equal = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda o: F.coalesce(F.get(F.col(a), o) == F.get(F.col(b), o), F.lit(False)))
    return let(F.array_position(equal, False), lambda p: F.when(p == 0, F.lit(n)).otherwise(p - 1)).cast("int")


def fingerprints(benchmark: DataFrame) -> DataFrame:
    """(size, hash, item_id, b_ahead, b_behind): size is SPAN for winnowed
    5-grams, else the length of a short item."""
    items = materialise(
        benchmark.select("item_id", alnum_words(whole_text("text")).alias("words"))
        .where(F.size("words") > 0).distinct(), "items")
    long = items.where(F.size("words") >= SPAN)
    kept = long.select("item_id", "words", _kept(_grams(F.col("words"), K)).alias("kept"))
    parts = [_places(kept, K, "item_id", "kept").where(F.array_contains("kept", F.col("hash")))
             .select(F.lit(SPAN).alias("size"), "hash", "item_id", "ahead", "behind")]
    short = items.where(F.size("words") < SPAN)
    for (n,) in short.select(F.size("words").alias("n")).distinct().orderBy("n").collect():  # under SPAN rows
        parts.append(_places(short.where(F.size("words") == n), n, "item_id")
                     .select(F.lit(n).alias("size"), "hash", "item_id", "ahead", "behind"))
    out = reduce(DataFrame.unionByName, parts)
    return materialise(out.withColumnsRenamed({"ahead": "b_ahead", "behind": "b_behind"}).distinct(),
                       "fingerprints")


def _join(left: DataFrame, prints: DataFrame, small: bool) -> DataFrame:
    return left.join(F.broadcast(prints) if small else prints, ["size", "hash"])


def spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, first, length): maximal runs around the
    matched fingerprints, `length` words of the document from word `first`."""
    prints = fingerprints(benchmark)
    small = prints.count() <= BROADCAST_ROWS
    sizes = [r[0] for r in prints.select("size").distinct().orderBy("size").collect()]  # SPAN rows at most
    rows = _keyed(docs)

    def runs(n):  # the words of a fingerprint
        return K if n == SPAN else n

    if not sizes:
        rows = rows.where(F.lit(False))
        sizes = [SPAN]
    first = reduce(DataFrame.unionByName, [
        rows.select("doc_id", "text_hash", F.lit(n).alias("size"), F.explode(
            _kept(_grams(F.col("words"), K)) if n == SPAN
            else F.array_distinct(_grams(F.col("words"), n))).alias("hash"))
        for n in sizes])
    met = materialise(_join(first, prints.select("size", "hash").distinct(), small)
                      .select("doc_id", "text_hash").distinct(), "met")
    again = rows.join(met, same(rows, met, "doc_id", "text_hash"), "left_semi")
    places = reduce(DataFrame.unionByName, [
        _places(again, runs(n), "doc_id", "text_hash").withColumn("size", F.lit(n)) for n in sizes])
    found = (_join(places, prints, small)
             .select("doc_id", "text_hash", "item_id", "place", "size",
                     _run("ahead", "b_ahead", SPAN).alias("after"),
                     _run("behind", "b_behind", WINDOW - 1).alias("before"))
             .withColumn("before", F.when(F.col("size") == SPAN, F.col("before")).otherwise(0))
             .where(F.col("before") + F.col("after") >= F.col("size")))
    return materialise(found.select("doc_id", "text_hash", "item_id", (F.col("place") - F.col("before")).alias("first"),
                                    (F.col("before") + F.col("after")).alias("length")).distinct(), "spans")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items,
    items_sha256 (of an empty string without items), contaminated."""
    key = ["doc_id", "text_hash"]
    found = spans(docs, benchmark)
    hit = (found.select(*key, F.explode(F.sequence("first", F.col("first") + F.col("length") - 1)).alias("word"))
           .distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit")))
    items = (found.select(*key, "item_id").distinct()
             .groupBy(*key).agg(F.count("item_id").alias("n_items"),
                                F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items")))
    both = hit.join(items, same(hit, items, *key)).select(hit["doc_id"], hit["text_hash"], "n_hit", "n_items", "items")
    both = materialise(both, "hits")
    rows = _keyed(docs).select(*key, F.size("words").cast("long").alias("n_words"))
    return (rows.join(both, same(rows, both, *key), "left")
            .select(rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without a benchmark window."""
    bad = materialise(spans(docs, benchmark).select("doc_id", "text_hash").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"])
                     & (F.xxhash64(whole_text(docs["text"])) == bad["text_hash"]), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n,
         array_to_string(words[s:s + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, s, array_to_string(words[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, sizes WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, item_id, s, p.n FROM places p JOIN windows w ON p.n = w.n AND p.win = w.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
