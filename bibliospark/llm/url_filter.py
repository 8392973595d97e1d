"""Operator 2, URL filters: host word segmentation and naive Bayes.

Rules decide first: a rule is a host and a path prefix; it fits the host and
its subdomains where the path starts so; the longest fitting rule wins. Urls
without a rule get a learned verdict. Names in hosts are concatenated words, so
each label of a host is split by a unigram Viterbi search: the split with the
largest product of word probabilities, learned from the words of all pages. The
segmented host and the path's tokens then go to a multinomial naive Bayes model
learned from all urls that a rule decided.

Plan: word counts and the model's counts are pre-aggregated shuffles over all
rows, kept whole as tables. The ``DICTIONARY`` most frequent words and the
``FEATURES`` most frequent tokens are also held by every task (50,000 short
words, a few MB); what a distinct host or url asks beyond these is joined with
the table, so each is split and judged by all counts. Pages get their verdict
by a join of written tables on (host, path), which AQE can split; counts of a
host are pre-aggregated before they meet its words.

Defined cases: a null url, or one without `://`, has an empty host and path and
no rule; it is judged by the classes' prior alone. With one class among the
ruled urls, or none, every other url is allowed or takes that class. Equal
scores allow. Equal rows give equal rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, small_batches

#: The rules, (host, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Words every task holds, the longest word, tokens every task holds.
DICTIONARY, LONGEST, FEATURES = 50_000, 24, 50_000
#: Names a task remembers.
REMEMBERED = 100_000


def _host_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.when(known, lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def ruled(pages: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest fitting rule, or
    null) and its verdict; a narrow projection."""
    host, path = _host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):  # the longest is the outermost
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def most_frequent(counts: DataFrame, size: int) -> list:
    """The rows of ``counts`` (with column n) of the largest counts, ``size`` at
    most: classes of nearly equal counts are taken whole, from the largest, while
    they fit. Only class sizes and the kept rows reach the driver."""
    counts = materialise(counts.withColumn("class", F.floor(F.log2(F.col("n")) * 64)), "counts")
    sizes = counts.groupBy("class").agg(F.count(F.lit(1)).alias("c")).collect()  # at most 64 * 64 rows
    left, least = size, None
    for k, c in sorted(((r["class"], r["c"]) for r in sizes), reverse=True):
        if c > left:
            break
        left, least = left - c, k
    return [] if least is None else counts.where(F.col("class") >= least).collect()


class Known(NamedTuple):
    """Values by word, counted over all pages: ``value(*counts)`` of the words in
    ``table`` (word, counts); tasks hold those of the most frequent. ``other`` is
    the least value, or that of an uncounted word; whole: the table has no others."""
    held: dict[str, float]
    table: DataFrame | None
    value: Callable[..., float]
    other: float
    whole: bool


def dictionary(pages: DataFrame, size: int = DICTIONARY) -> Known:
    """Log probabilities of the words of all pages' texts."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", " ")
    words = (pages.select(F.explode(F.split(lower_ascii(text), r"[^a-z]+")).alias("word"))
             .where((F.length("word") > 0) & (F.length("word") <= LONGEST))
             .groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    words = materialise(words, "words")
    all_ = words.agg(F.sum("n").alias("total"), F.min("n").alias("least"), F.count(F.lit(1)).alias("n")).first()
    total = all_["total"] or 1

    def value(n):
        return math.log(n / total)
    held = {r["word"]: value(r["n"]) for r in most_frequent(words, size)}
    return Known(held, words.select("word", F.array("n").alias("counts")), value,
                 value(all_["least"] or 1), len(held) == all_["n"])


def looked_up(items: DataFrame, keys: list[str], ask, known: Known) -> DataFrame:
    """``items`` (distinct by their key columns, which come first) with ``found``:
    (word, counts) of the words that ``ask(row)`` names and tasks do not hold."""
    if known.whole:
        return items.withColumn("found", F.array().cast("array<struct<word:string,counts:array<bigint>>>"))

    def asked(batches):
        for b in batches:
            out = [(*r[:len(keys)], w) for r in zip(*[c.to_pylist() for c in b.columns]) for w in sorted(ask(r))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(len(keys) + 1)],
                                             [*keys, "word"])
    hits = items.mapInArrow(asked, ", ".join(f"{k} string" for k in [*keys, "word"])).join(known.table, "word")
    hits = materialise(hits, "looked-up")
    found = materialise(hits.groupBy(*keys).agg(F.collect_list(F.struct("word", "counts")).alias("found")), "found")
    return items.join(found, keys, "left")


def _values(found, known: Known) -> dict[str, float]:
    return {r["word"]: known.value(*r["counts"]) for r in found or ()}


class Segmenter:
    """Unigram Viterbi splits of concatenated names."""

    def __init__(self, words: dict[str, float], least: float | None = None):
        self.words, self.known = words, {}
        # an unknown run is less likely than any word and costs more the longer it is
        self.unknown = (min(words.values(), default=0.0) if least is None else least) - 2.0

    def split(self, name: str, more: dict[str, float] | None = None) -> list[str]:
        """The best split; ``more`` are words that only this name is known to hold."""
        if more:
            return self._split(name, more)
        got = self.known.get(name)
        if got is None:
            got = self._split(name, {})
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[name] = got
        return got

    def _split(self, name: str, more: dict[str, float]) -> list[str]:
        best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                p = self.words.get(word)
                if p is None:
                    p = more.get(word)
                score = best[start] + (p if p is not None else self.unknown - 3.0 * (end - start))
                if score > best[end]:
                    best[end], cut[end] = score, start
        out, end = [], len(name)
        while end:
            out.append(name[cut[end]:end])
            end = cut[end]
        return out[::-1]


def _host_parts(host: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9]+", host) if x]


def host_tokens(host: str, segmenter: Segmenter, more: dict[str, float] | None = None) -> list[str]:
    """Host words; parts with digits stay whole."""
    return ["h:" + w for x in _host_parts(host) for w in (segmenter.split(x, more) if x.isalpha() else [x])]


def path_tokens(path: str) -> list[str]:
    """Path tokens, apart from host words; numbers as one token."""
    return ["p:#" if x.isdigit() else "p:" + x for x in re.split(r"[^a-z0-9]+", path.lower()) if x]


def _substrings(host: str, held) -> set[str]:
    """What the host's words may be beyond those held."""
    return {x[a:b] for x in _host_parts(host) if x.isalpha()
            for a in range(len(x)) for b in range(a + 1, min(a + LONGEST, len(x)) + 1)}.difference(held)


def split_hosts(rows: DataFrame, words: Known) -> DataFrame:
    """(host, words) of the distinct hosts."""
    # tasks get the values, not the table
    task = words._replace(table=None)

    def split(batches):
        segmenter = Segmenter(task.held, task.other)
        for b in batches:
            hosts, found = [c.to_pylist() for c in b.columns]
            out = [host_tokens(h, segmenter, _values(x, task)) for h, x in zip(hosts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["host", "words"])

    hosts = materialise(rows.select("host").distinct(), "hosts")
    held = task.held
    found = looked_up(hosts, ["host"], lambda row: _substrings(row[0], held), words)
    return materialise(found.select("host", "found").mapInArrow(split, "host string, words array<string>"), "host-words")


def _path_rows(rows: DataFrame) -> DataFrame:
    """One row per token of a ruled url's path: token, ruled, n."""
    def cut(batches):
        for b in batches:
            out = [(t, v) for p, v in zip(*[c.to_pylist() for c in b.columns]) for t in path_tokens(p)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)],
                                             ["token", "ruled"])
    return rows.select("path", "ruled").mapInArrow(cut, "token string, ruled string").withColumn("n", F.lit(1).cast("long"))


def train(rows: DataFrame, hosts: DataFrame, size: int = FEATURES) -> tuple[Known, float]:
    """Weights log P(token | block) - log P(token | allow) by token and the
    prior's; learned from all rows with a rule's verdict."""
    labelled = rows.where("ruled is not null")
    classes = {r["ruled"]: r["count"] for r in labelled.groupBy("ruled").count().collect()}  # two rows
    n_block, n_allow = classes.get("block", 0), classes.get("allow", 0)
    if not n_block or not n_allow:
        return Known({}, None, float, 0.0, True), float("inf") if n_block else float("-inf")
    ruled_hosts = labelled.groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("n"))
    host_rows = ruled_hosts.join(hosts, "host").select(F.explode("words").alias("token"), "ruled", "n")
    counts = (host_rows.unionByName(_path_rows(labelled)).groupBy("token")
              .agg(F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("block"),
                   F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("allow")))
    counts = materialise(counts, "url-tokens")
    total = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    below_block, below_allow = (total["block"] or 0) + total["n"] + 1, (total["allow"] or 0) + total["n"] + 1

    def value(block, allow):
        return math.log((block + 1) / below_block) - math.log((allow + 1) / below_allow)
    held = {r["token"]: value(r["block"], r["allow"])
            for r in most_frequent(counts.withColumn("n", F.col("block") + F.col("allow")), size)}
    table = counts.select(F.col("token").alias("word"), F.array("block", "allow").alias("counts"))
    return Known(held, table, value, value(0, 0), len(held) == total["n"]), math.log(n_block / n_allow)


def judge(pages: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and
    block_score, the model's log odds of block (null where a rule decided)."""
    small_batches(pages.sparkSession)
    rows = ruled(pages, rules).withColumn("page_id", F.col("page_id").cast("long"))
    hosts = split_hosts(rows, dictionary(pages))
    weights, prior = train(rows, hosts)
    task = weights._replace(table=None)

    def with_path(batches):
        for b in batches:
            host, path, words = [c.to_pylist() for c in b.columns]
            out = [w + path_tokens(p) for w, p in zip(words, path)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.list_(pa.string()))], ["host", "path", "tokens"])

    def score(batches):
        for b in batches:
            _, _, tokens, found = [c.to_pylist() for c in b.columns]
            odds = []
            for ts, x in zip(tokens, found):
                more = _values(x, task)
                odds.append(prior + sum(task.held[t] if t in task.held else more.get(t, task.other) for t in ts))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(odds, pa.float64())], ["host", "path", "block_score"])

    asking = rows.where("ruled is null")
    urls = materialise(asking.select("host", "path").distinct().join(hosts, "host").select("host", "path", "words"), "urls")
    urls = urls.mapInArrow(with_path, "host string, path string, tokens array<string>")
    held = task.held
    found = looked_up(urls, ["host", "path"], lambda row: set(row[2]).difference(held), weights)
    scored = materialise(found.select("host", "path", "tokens", "found")
                         .mapInArrow(score, "host string, path string, block_score double"), "scored")
    judged = asking.join(scored, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.when(F.col("block_score") > 0, "block").otherwise("allow").alias("verdict"),
        "block_score")
    decided = rows.where("ruled is not null").select(
        "page_id", "host", "path", "rule", F.col("ruled").alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    return decided.unionByName(judged)
