"""Operator 3, suffix-array dedup: column-wise multi-document construction.

Finds every 400-byte string that starts at two places or more of the
collection and removes each byte that such a string covers.

1. Anchors. Every 400-byte window has an anchor: of its byte 48-grams the one
   with the smallest hash, the last of equals. Equal windows have equal anchors
   at equal offsets. Successive windows of one anchor form its region (about
   580 bytes of text, one per 177 bytes).
2. Regions meet by their anchor's hash. Equal regions are repeats as a whole
   (copies are settled here, by 128-bit hashes). A region that shares its anchor
   with a different one needs its text compared.
3. Those regions, aligned at their anchors, are the documents of a collection.
   It is built column by column from the right: each round inserts one symbol
   per document, sorts the new suffixes stably by it (the round's column of the
   Burrows-Wheeler transform) and renews the common prefixes of neighbours. A
   suffix whose common prefix with a neighbour reaches 400 is a repeated window.
   The alignment makes rounds as few as a region's bytes, not a document's.
4. Removed runs return to their documents and are merged there.

Plan: anchors travel as packed records dealt by hash; regions that need it are
written to a table in the shared folder and read in sequence, a group of
anchors at a time. An anchor with more than ``BLOCK`` different regions is cut
into blocks built on their own; windows they leave open are then counted by
128-bit hash over all blocks, so a hot passage is exact and no group is
unbounded. Whole texts shuffle twice: to cut regions, and to apply the runs.

Defined cases: null text is empty and returns zeros; texts under 400 bytes
have no window; rows with equal doc_id and text are separate places of the
collection, so they repeat each other. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Dealer, buckets_for, materialise, small_batches, whole_text

LENGTH = 400
GRAM = 48
#: Different regions of one anchor built together, and regions of one build.
BLOCK, BUILD = 4096, 8192
BUCKETS_PER_PARTITION = 2
_B = 0x9E3779B97F4A7C15 | 1  # an odd multiplier, for the rolling hash modulo 2^64
_STEP = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP = None


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of every gram of the bytes."""
    global _UP
    if _UP is None:
        _UP = _powers(_B, _STEP + 4096), _powers(pow(_B, -1, 1 << 64), _STEP + 4096)
    out = np.empty(max(len(data) - gram + 1, 0), np.uint64)
    for k in range(0, len(out), _STEP):  # the powers are bounded; a long text is hashed in steps
        part = data[k:k + _STEP + gram - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[0][:len(part)], out=total[1:])
        n = len(part) - gram + 1
        out[k:k + n] = (total[gram:] - total[:n]) * _UP[1][:n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values."""
    n = -(-len(x) // width) * width
    padded = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:len(x) - width + 1], ahead[width - 1:len(x)])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(anchor, first, last window, hash) arrays: the windows of a text by anchor."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    h = gram_hashes(data, gram)
    low = np.uint64(0xFFFFFFFF)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the last is least
    at = (low - (_window_least(key, length - gram + 1) & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], first, last, h[at[first]]


def repeated_windows(regions: list[bytes], lefts: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each region, runs (first, last) of the windows, from its start, that
    another region repeats at the same distance to the anchor; ``lefts`` are the
    bytes before the anchors. Builds the collection column by column."""
    m = len(regions)
    left = max(lefts)
    width = max(left - a + len(r) for a, r in zip(lefts, regions))
    symbols = np.zeros((m, width), np.uint16)  # 0: outside the region
    for k, (a, r) in enumerate(zip(lefts, regions)):
        symbols[k, left - a:left - a + len(r)] = np.frombuffer(r, np.uint8).astype(np.uint16) + 1
    symbols = np.ascontiguousarray(symbols.T)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # common[p]: prefix shared by suffixes p - 1 and p
    found = np.zeros((left + 1, m), bool)
    for column in range(width - 1, -1, -1):
        by = symbols[column][order]
        moved = np.argsort(by, kind="stable")
        by = by[moved]
        equal = np.flatnonzero((by[1:] == by[:-1]) & (by[1:] > 0))
        before, here = moved[equal] + 1, moved[equal + 1]
        least = common[here]
        apart = np.flatnonzero(here > before)
        if len(apart):  # the least common prefix between the two old places
            bounds = np.empty(2 * len(apart), np.int64)
            bounds[0::2], bounds[1::2] = before[apart], here[apart] + 1
            least[apart] = np.minimum.reduceat(common, bounds)[::2]
        common = np.zeros(m + 1, np.int32)
        common[equal + 1] = least + 1
        order = order[moved]
        if column <= left:
            long = common[:m] >= length
            if long.any():
                long[:-1] |= long[1:].copy()
                found[column, order[long]] = True
    out = []
    for k, a in enumerate(lefts):
        edge = np.diff(np.concatenate(([0], found[left - a:, k].astype(np.int8), [0])))
        out.append(list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist())))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = whole_text("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id"), text).alias("uid"), text.alias("text"))


def _bytes(column) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _shared(texts: DataFrame, length: int, buckets: int, block: int) -> DataFrame:
    """(uid, regions): packed (anchor hash, first, last window, anchor, part, blocks)
    of regions that share their anchor; part -1: a repeat as a whole, to be
    compared with nothing; copies of one region are compared once."""
    def deal(batches):
        dealer = Dealer(buckets)
        for b in batches:
            for uid, raw in zip(b.column(0).to_pylist(), _bytes(b.column(1))):
                at, first, last, h = anchors(np.frombuffer(raw, np.uint8), length)
                if not len(at):
                    continue
                record = np.empty((len(at), 6), np.uint64)
                record[:, 0], record[:, 3] = h, np.uint64(uid % (1 << 64))
                content = b"".join(xxhash.xxh3_128_digest(raw[f:e + length], seed=a - f) for a, f, e in
                                   zip(at.tolist(), first.tolist(), last.tolist()))
                record[:, 1:3] = np.frombuffer(content, np.uint64).reshape(-1, 2)
                record[:, 4] = first
                record[:, 5] = (last - first) << 32 | (at - first)
                dealer.add(record, h)
            yield from dealer.full()
        yield from dealer.rest()

    def meet(table):
        record = Dealer.read(table, 6)
        record = record[np.lexsort((record[:, 4], record[:, 3], record[:, 2], record[:, 1], record[:, 0]))]

        def starts(words):
            return np.flatnonzero(np.concatenate(([True], (record[1:, :words] != record[:-1, :words]).any(axis=1))))
        region, anchor = starts(3), starts(1)
        copies = np.diff(np.concatenate((region, [len(record)])))
        of_anchor = np.searchsorted(anchor, region, "right") - 1  # of each distinct region
        different = np.bincount(of_anchor, minlength=len(anchor))
        blocks = -(-different // block)
        number = np.arange(len(region)) - np.searchsorted(of_anchor, of_anchor)
        part = np.where(different[of_anchor] > 1, number % blocks[of_anchor], -1)
        # every place of a repeated region, and one place of each region to compare
        whole = np.repeat(copies > 1, copies)
        lead = np.zeros(len(record), bool)
        lead[region] = part >= 0
        run = np.repeat(np.arange(len(region)), copies)
        keep = whole | lead
        r, run, lead = record[keep], run[keep], lead[keep]
        p = np.where(lead, part[run], -1)
        return pa.table([
            pa.array(r[:, 3].view(np.int64)), pa.array(r[:, 0].view(np.int64)), pa.array(r[:, 4].view(np.int64)),
            pa.array((r[:, 5] >> np.uint64(32)).astype(np.int64)), pa.array((r[:, 5] & np.uint64(0xFFFFFFFF)).astype(np.int64)),
            pa.array(p, pa.int32()), pa.array(blocks[of_anchor[run]], pa.int32()), pa.array(whole[keep])],
            ["uid", "anchor", "first", "more", "at", "part", "blocks", "whole"])

    return (texts.select("uid", "text").mapInArrow(deal, Dealer.SCHEMA).groupBy("bucket")
            .applyInArrow(meet, "uid long, anchor long, first long, more long, at long, part int, blocks int, whole boolean"))


_WINDOWS = "uid long, first long, last long, h1 long, h2 long"


def _build(regions: DataFrame, length: int) -> DataFrame:
    """(uid, first, last) runs of repeated windows, and for regions of an anchor
    cut into blocks (uid, first, first, h1, h2) of each window, hashed."""
    def build(batches):
        def done(rows):
            many = [r for r in rows if r[4] > 1]
            out = []
            for (_, _, uid, first, _, _, _, _), runs in zip(
                    rows, repeated_windows([r[7] for r in rows], [r[6] for r in rows], length)):
                out += [(uid, first + a, first + b, None, None) for a, b in runs]
            for _, _, uid, first, _, more, _, raw in many:
                for k in range(more + 1):
                    h = xxhash.xxh3_128_digest(raw[k:k + length])
                    out.append((uid, first + k, first + k, int.from_bytes(h[:8], "big", signed=True),
                                int.from_bytes(h[8:], "big", signed=True)))
            for k in range(0, len(out), 100_000):
                cols = list(zip(*out[k:k + 100_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 ["uid", "first", "last", "h1", "h2"])

        rows, group = [], None
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if r[:2] != group:
                    if len(rows) >= BUILD:
                        yield from done(rows)
                        rows = []
                    group = r[:2]
                rows.append(r)
        if rows:
            yield from done(rows)

    return (regions.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
            .select("anchor", "part", "uid", "first", "blocks", "more", "at", "raw").mapInArrow(build, _WINDOWS))


def runs(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(uid, first, last): runs of windows of a document that occur elsewhere
    too; runs of one document may meet."""
    small_batches(docs.sparkSession)
    texts = _keyed(docs)
    shared = materialise(_shared(texts, length, buckets_for(docs, BUCKETS_PER_PARTITION), block), "shared-regions")
    whole = shared.where("whole").select("uid", "first", (F.col("first") + F.col("more")).alias("last"))

    # cut the regions to compare out of their texts, a row each
    wanted = (shared.where("part >= 0").groupBy("uid")
              .agg(F.collect_list(F.struct("anchor", "first", "more", "at", "part", "blocks")).alias("wanted")))
    wanted = materialise(wanted, "wanted-regions")
    joined = texts.select("uid", "text").join(wanted, "uid")

    def cut(batches):
        for b in batches:
            rows = []
            for uid, raw, regions in zip(b.column(0).to_pylist(), _bytes(b.column(1)), b.column(2).to_pylist()):
                rows += [(g["anchor"], g["part"], uid, g["first"], g["blocks"], g["more"], g["at"],
                          raw[g["first"]:g["first"] + g["more"] + length]) for g in regions]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(),
                                                       pa.int64(), pa.int64(), pa.binary()])],
                ["anchor", "part", "uid", "first", "blocks", "more", "at", "raw"])

    regions = joined.mapInArrow(cut, "anchor long, part int, uid long, first long, blocks int, more long, at long, raw binary")
    built = materialise(_build(materialise(regions, "regions"), length), "built")
    # windows of anchors in several blocks: repeated if their content occurs twice in all
    open_windows = built.where("h1 is not null")
    twice = materialise(open_windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                        .select("h1", "h2"), "twice")
    late = open_windows.join(twice, ["h1", "h2"], "left_semi")
    return (whole.unionByName(built.where("h1 is null").select("uid", "first", "last"))
            .unionByName(late.select("uid", "first", "last")))


def _merged(found: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte runs [a, b) covered by windows, merged where they touch."""
    out = []
    for first, last in sorted((r["first"], r["last"]) for r in found):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return out


def judge(docs: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256 of the bytes that stay, and spans, the removed byte runs."""
    found = runs(docs, length, block)
    per_doc = materialise(found.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("found")), "found-runs")
    texts = _keyed(docs)
    joined = texts.join(per_doc, "uid", "left").select("doc_id", "text", "found")

    def apply(batches):
        for b in batches:
            out = []
            for raw, got in zip(_bytes(b.column(1)), b.column(2).to_pylist()):
                spans = _merged(got or [], length)
                digest, at = hashlib.sha256(), 0
                for a, e in spans:
                    digest.update(raw[at:a])
                    at = e
                digest.update(raw[at:])
                out.append((len(raw), sum(e - a for a, e in spans), len(spans), digest.hexdigest(), spans))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()),
                 pa.array(cols[4], pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                    "spans array<array<long>>")


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).drop("spans")
