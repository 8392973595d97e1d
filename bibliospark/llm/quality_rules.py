"""Operator 1, quality rules [native]: cross-document line frequency.

Normalised lines are hashed, the distinct documents of every line are counted
per host (`source`), lines above both limits count as boilerplate, and a
document that keeps too little without its boilerplate is rejected as
depleted. A document's own figures (words, symbols, repeated lines and word
windows) come from array expressions inside its row.

Plan: the figures need no shuffle. Line counts shuffle (host, line hash, text
hash), pre-aggregated in each task, never the lines. Equal texts of a host
count as one document, so a group of exact copies is not boilerplate (copies
are the near-duplicate stage's). Boilerplate lines and depleted documents are
written tables, so their joins read plain scans: broadcast when small, else
sorted, with skewed partitions split.

Defined cases: null text has no words and fails the base rules; a null host is
a host of its own; equal rows give equal rows; other columns are not read.
Lines are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, let, lower_ascii, materialise, same, space_words, whole_text

#: A line is boilerplate on a host from this many distinct documents ...
MIN_DOCS = 10
#: ... and this share of the host's distinct documents.
MIN_SHARE = 0.05
#: A document is depleted when more than this share of its characters is boilerplate.
MAX_REMOVED = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


def _no_space(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""
    def covered(at):  # `at`: sorted first words of repeated windows
        return F.aggregate(
            F.transform(at, lambda p, k: F.least(F.get(at, k + 1) - p, F.lit(3))),
            F.lit(0), lambda acc, x: acc + x)

    def repeated(s):  # `s`: (hash, place) of every window, sorted
        return F.sort_array(F.transform(
            F.filter(s, lambda e, k: (e["h"] == F.get(s, k + 1)["h"]) | (e["h"] == F.get(s, k - 1)["h"])),
            lambda e: e["i"]))

    windows = F.transform(words, lambda x, i: F.struct(
        F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    windows = F.slice(windows, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.sort_array(windows), lambda s: let(repeated(s), covered))


def _figures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: _no_space(x) != "")
    return let(space_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(_no_space(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def _base_failed(f: Column) -> Column:
    return ((f["n_words"] < MIN_WORDS)
            | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("host"), whole_text("text").alias("text"),
                       F.xxhash64(whole_text("text")).alias("text_hash"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, place, line_hash, chars) of every line with a
    word; normalised: A-Z lower-cased, white space runs to one blank, ends trimmed."""
    line = F.trim(F.regexp_replace(lower_ascii(F.col("line")), r"[\t\x0B\f\r ]+", " "))
    return (_keyed(docs)
            .select("doc_id", "host", "text_hash", F.posexplode(F.split("text", "\n")).alias("place", "line"))
            .select("doc_id", "host", "text_hash", "place", line.alias("line"))
            .where(F.col("line") != "")
            .select("doc_id", "host", "text_hash", "place", F.xxhash64("line").alias("line_hash"),
                    F.length(_no_space(F.col("line"))).cast("long").alias("chars")))


def boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line_hash, n_docs) of the lines above both limits."""
    host_docs = (_keyed(docs).select("host", "text_hash").distinct()
                 .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
    counts = (lines_of(docs).select("host", "line_hash", "text_hash").distinct()
              .groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs"))
              .where(F.col("n_docs") >= min_docs))
    return (counts.join(host_docs, same(counts, host_docs, "host"))
            .where(F.col("n_docs") >= F.col("host_docs") * min_share)
            .select(counts["host"], "line_hash", "n_docs"))


def _hits(docs: DataFrame, min_docs: int, min_share: float, *more: Column) -> DataFrame:
    """(doc_id, host, text_hash, lost) of documents with boilerplate: its
    characters, and ``more`` aggregates of its lines."""
    frequent = materialise(boilerplate(docs, min_docs, min_share), "boilerplate")
    lines = lines_of(docs)
    hit = lines.join(frequent, same(lines, frequent, "host", "line_hash"), "left_semi")
    # a repeated row repeats its lines: count each place once
    lost = (hit.distinct().groupBy("doc_id", "host", "text_hash")
            .agg(F.sum("chars").alias("lost"), *more))
    return materialise(lost, "lost-chars")


def depleted(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
             max_removed: float = MAX_REMOVED) -> DataFrame:
    """(doc_id, host, text_hash) of documents that lose more than ``max_removed``
    of their characters with the boilerplate lines; a row each."""
    lost = _hits(docs, min_docs, min_share)
    keyed = _keyed(docs).select("doc_id", "host", "text_hash", F.length(_no_space(F.col("text"))).alias("chars"))
    return (keyed.join(lost, same(keyed, lost, "doc_id", "host", "text_hash"))
            .where(F.col("lost") > F.col("chars") * max_removed)
            .select(keyed["doc_id"], keyed["host"], keyed["text_hash"]).distinct())


def strip_boilerplate(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(doc_id, host, place) of the lines to remove: the operator's line verdicts."""
    frequent = materialise(boilerplate(docs, min_docs, min_share), "boilerplate")
    lines = lines_of(docs)
    return (lines.join(frequent, same(lines, frequent, "host", "line_hash"), "left_semi")
            .select("doc_id", "host", "place").distinct())


def judge(docs: DataFrame, **limits) -> DataFrame:
    """One row per row of ``docs``: doc_id, the figures, base_failed, depleted, kept."""
    gone = materialise(depleted(docs, **limits), "depleted").withColumn("depleted", F.lit(True))
    rows = _keyed(docs).select("doc_id", "host", "text_hash", _figures(F.col("text")).alias("f"))
    out = (rows.join(gone, same(rows, gone, "doc_id", "host", "text_hash"), "left")
           .select(rows["doc_id"], "f.*", _base_failed(F.col("f")).alias("base_failed"),
                   F.coalesce("depleted", F.lit(False)).alias("depleted")))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the rules."""
    gone = materialise(depleted(docs, **limits), "depleted")
    text = whole_text("text")
    passed = docs.where(~let(_figures(text), _base_failed))
    return passed.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"])
                       & docs["source"].eqNullSafe(gone["host"])
                       & (F.xxhash64(whole_text(docs["text"])) == gone["text_hash"]), "left_anti")


def strip_good(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE,
               max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows of ``keep_good``, all columns, without their boilerplate lines;
    n_chars, if there, follows the text."""
    hits = _hits(docs, min_docs, min_share, F.collect_list("place").alias("places"))
    hits = hits.select(F.col("doc_id").alias("\0doc"), F.col("host").alias("\0host"), F.col("text_hash").alias("\0hash"),
                       F.col("lost").alias("\0lost"), F.col("places").alias("\0places"))
    text = whole_text(docs["text"])
    passed = docs.where(~let(_figures(text), _base_failed))
    passed = passed.join(hits, docs["doc_id"].eqNullSafe(hits["\0doc"]) & docs["source"].eqNullSafe(hits["\0host"])
                         & (F.xxhash64(text) == hits["\0hash"]), "left")
    whole = F.col("\0lost").isNull()
    passed = passed.where(whole | (F.col("\0lost") <= F.length(_no_space(text)) * max_removed))

    def rest(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("\0places"))
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    out = passed.withColumn("text", F.when(whole, docs["text"]).otherwise(let(F.split(text, "\n"), rest)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), g AS (
  SELECT doc_id, text, p, words[p] || ' ' || words[p+1] || ' ' || words[p+2] AS gram
  FROM (SELECT doc_id, text, words, unnest(range(1, len(words) - 1)) AS p FROM w)
), r AS (
  SELECT doc_id, text, p FROM g
  QUALIFY count(*) OVER (PARTITION BY doc_id, text, gram) > 1
), rep AS (
  SELECT doc_id, text, count(*) AS n FROM (
    SELECT DISTINCT doc_id, text, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY ALL
), raw AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d
), lines AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[\x09\x0B-\x0D ]+', ' ', 'g'), ' ') AS norm
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT doc_id, text, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY ALL
), hosts AS (
  SELECT host, count(DISTINCT text) AS n FROM d GROUP BY host
), freq AS (
  SELECT l.host, l.norm FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  GROUP BY l.host, l.norm, h.n HAVING count(DISTINCT text) >= 10 AND count(DISTINCT text) >= 0.05 * h.n
), lost AS (
  SELECT l.doc_id, l.text, sum(length(regexp_replace(l.norm, ' ', '', 'g'))) AS n
  FROM lines l JOIN freq f ON l.norm = f.norm AND l.host IS NOT DISTINCT FROM f.host GROUP BY ALL
), b AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(w.text) - length(translate(w.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.n, 0) AS lost
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id AND w.text = dup.text
  LEFT JOIN rep ON w.doc_id = rep.doc_id AND w.text = rep.text
  LEFT JOIN lost ON w.doc_id = lost.doc_id AND w.text = lost.text
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       lost > 0.5 * word_chars AS depleted,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost > 0.5 * word_chars AS kept
FROM b
"""
