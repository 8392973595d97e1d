"""Operator 10, license scans: exact set-similarity join with templates.

A text is covered by blocks of ``BLOCK_WORDS`` words, one every half block, so
whatever fits half a block lies whole in one. A block meets a template when it
holds at least ``CONTAINMENT`` of the template's distinct words. Words are
ordered by their frequency in the whole corpus, rarest first. By the prefix
filter a template of n words that needs m shares one of its first n - m + 1
words with every block that meets it: only those rare words are joined. The
length filter drops blocks of under m distinct words; the positional filter
drops those where the words from the first shared place on are too few on
either side. What is left is counted exactly.

Plan: the templates are fixed and few, so their words are broadcast (under 200
rows whatever the data). Two narrow passes over the words, one that counts the
template words and one that joins the prefixes, and a third over the
documents with a candidate. No word is shuffled but counts and candidates.

Defined cases: null text has no words; equal rows give equal rows; without a
base phrase first_word and last_word are null and base_labels is empty; the
score is 1 with a base phrase, else the best containment found, else 0. Other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, let, materialise, same, whole_text

CONTAINMENT = 0.8
BLOCK_WORDS = 96

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of common licenses, as their users quote them.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
]


def _template_words(spark: SparkSession) -> DataFrame:
    """(template, label, word) of the distinct words; fixed and small."""
    rows = [(k, label, w) for k, (label, text) in enumerate(TEMPLATES) for w in dict.fromkeys(text.split())]
    return spark.createDataFrame(rows, "template int, label string, word string")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(whole_text("text")).alias("text_hash"),
                       alnum_words(whole_text("text")).alias("words"))


def ordered_templates(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(template, label, words, size, need): words rarest in the corpus first,
    need the shared words that meet the threshold."""
    words = _template_words(docs.sparkSession)
    vocabulary = F.broadcast(words.select("word").distinct())
    counts = (_keyed(docs).select(F.explode("words").alias("word")).join(vocabulary, "word")
              .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    ranked = words.join(F.broadcast(counts), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return materialise(
        ranked.groupBy("template", "label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("words"))
        .withColumn("size", F.size("words"))
        .withColumn("need", F.ceil(F.col("size") * F.lit(containment) - F.lit(1e-9)).cast("int")), "templates")


def _block(words: Column, number: Column) -> Column:
    half = BLOCK_WORDS // 2
    return F.array_distinct(F.slice(words, number * half + 1, F.lit(BLOCK_WORDS)))


def matches(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, block, label, shared, size): every block that meets a
    template; the block starts at word block * BLOCK_WORDS / 2."""
    half = BLOCK_WORDS // 2
    templates = ordered_templates(docs, containment)
    prefix = templates.select("template", F.posexplode(F.slice(
        "words", F.lit(1), F.col("size") - F.col("need") + 1)).alias("place", "word"))
    rows = _keyed(docs)
    hits = (rows.select("doc_id", "text_hash", F.posexplode("words").alias("at", "word"))
            .join(F.broadcast(prefix), "word"))
    last = F.floor(F.col("at") / half).cast("int")
    # word `at` lies in the block of its half and in the one before
    found = (hits.select("doc_id", "text_hash", "template", "place",
                         F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))).alias("block"))
             .groupBy("doc_id", "text_hash", "template", "block").agg(F.min("place").alias("place")))
    wanted = (found.groupBy("doc_id", "text_hash")
              .agg(F.collect_list(F.struct("block", "template", "place")).alias("wanted")))
    wanted = materialise(wanted, "license-candidates")
    blocks = (rows.join(wanted, same(rows, wanted, "doc_id", "text_hash"))
              .select(rows["doc_id"], rows["text_hash"],
                      F.explode(let(F.col("words"), lambda w: F.transform(F.col("wanted"), lambda c: F.struct(
                          c["block"].alias("block"), c["template"].alias("template"), c["place"].alias("place"),
                          _block(w, c["block"]).alias("tokens"))))).alias("c"))
              .select("doc_id", "text_hash", "c.*"))
    shared = F.size(F.array_intersect("words", "tokens"))
    # the first shared word stands at `place`: what the template has from there on
    # bounds the overlap, as does the block's size
    bound = F.least(F.col("size") - F.col("place"), F.size("tokens"))
    return (blocks.join(F.broadcast(templates), "template")
            .where((F.size("tokens") >= F.col("need")) & (bound >= F.col("need")))
            .withColumn("shared", shared).where(F.col("shared") >= F.col("need"))
            .select("doc_id", "text_hash", "block", "label", "shared", "size"))


def _places(words: Column) -> Column:
    """(place, label) of every phrase."""
    def of(phrase, label):
        parts = phrase.split()

        def stands(e):
            out = e["w"] == parts[0]
            for k, p in enumerate(parts[1:], 1):
                out = out & (F.coalesce(F.get(words, e["i"] + k), F.lit("")) == p)
            return out
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.transform(F.filter(numbered, stands),
                           lambda e: F.struct(e["i"].cast("long").alias("place"), F.lit(label).alias("label")))
    return F.concat(*[of(p, label) for p, label in PHRASES.items()])


def scan(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    found = (matches(docs, containment).groupBy("doc_id", "text_hash")
             .agg(F.collect_set("label").alias("own"), F.max(F.col("shared") / F.col("size")).alias("best")))
    found = materialise(found, "license-labels")
    none = F.array().cast("array<struct<place:bigint,label:string>>")
    base = let(F.col("words"), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.when(F.array_contains(w, "license"), _places(w)).otherwise(none).alias("places")))
    rows = _keyed(docs).select("doc_id", "text_hash", base.alias("b"))
    labels = F.transform("b.places", lambda p: p["label"])
    starts = F.transform("b.places", lambda p: p["place"])
    joined = rows.join(found, same(rows, found, "doc_id", "text_hash"), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        rows["doc_id"], "b.n_words", F.size("b.places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.coalesce("own", empty))), ",").alias("labels"),
        F.when(F.size("b.places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql() -> str:
    templates = ",\n  ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    phrases = ",\n  ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), phrases(phrase, label) AS (VALUES
  {phrases}
), templates(template, label, body) AS (VALUES
  {templates}
), tw AS (
  SELECT DISTINCT template, label, unnest(string_split(body, ' ')) AS word FROM templates
), sizes AS (SELECT template, label, count(*) AS size FROM tw GROUP BY ALL
), pos AS (
  SELECT doc_id, words, unnest(range(len(words))) AS spot FROM d
), base AS (
  SELECT doc_id, spot, label FROM pos, phrases
  WHERE words[spot + 1] = split_part(phrase, ' ', 1)
    AND array_to_string(words[spot + 1:spot + len(string_split(phrase, ' '))], ' ') = phrase
), b AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels, list(DISTINCT label) AS ls FROM base GROUP BY doc_id
), tokens AS (
  SELECT DISTINCT doc_id, block, word FROM (
    SELECT doc_id, words[spot + 1] AS word, unnest([spot // 48, greatest(spot // 48 - 1, 0)]) AS block FROM pos)
  WHERE word IN (SELECT word FROM tw)
), met AS (
  SELECT doc_id, s.label, count(*) / s.size AS part FROM tokens JOIN tw USING (word) JOIN sizes s USING (template)
  GROUP BY doc_id, block, template, s.label, s.size HAVING count(*) >= ceil(s.size * 0.8 - 1e-9)
), m AS (SELECT doc_id, list(DISTINCT label) AS ls, max(part) AS best FROM met GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


SQL = _sql()
