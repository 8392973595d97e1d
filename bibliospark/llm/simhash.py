"""Operator 4, SimHash near-dedup: BK-trees over fingerprint shards.

Fingerprints: 64 bits, a bit set when over half of a text's word-shingle
hashes (XXH64, seed 42) set it. Equal fingerprints are folded first. Two
fingerprints within r differing bits agree on at least two of r + 2 equal
blocks of bits, so each is dealt to a shard per pair of blocks; every linked
pair meets in one. A shard is a BK-tree (children keyed by their integer
Hamming distance to the parent); a search follows only edges whose distance
lies within the radius of the query's. Links within a shard are reported as
links to the root of their local component, never as all pairs.

Shards are sent by key, not broadcast: together they grow with the data. A
shard above ``SHARD`` fingerprints is cut into several trees, and its queries
into blocks; every block meets every tree in its own task group, so one key
holding a third of the rows spreads out and no group is unbounded.

Defined cases: null or empty text and text without words have fingerprint 0
and link like any other; equal rows give equal rows; a null doc_id has a
component like any other and is ignored by the smallest id. Other columns are
not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, same, small_batches, whole_text

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Most fingerprints of one tree; a larger shard is cut into more trees.
SHARD = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of one whole text; 0 without words."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle]))
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED)
                  for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # bounded memory however long the text
        part = np.array(hashes[k:k + 65536], ">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row of ``docs``."""
    def prints(batches):
        for b in batches:
            fp = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())],
                                             ["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    text = whole_text("text")
    return (docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
            .mapInArrow(prints, "doc_id long, text_hash long, fp long"))


class BKTree:
    """Distinct integers under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.values.append(x)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ x).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = nxt

    def near(self, x: int, radius: int):
        """Places of the values within the radius."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ x).bit_count()
            if d <= radius:
                yield at
            kids = self.children[at]
            if kids:
                stack += [k for e, k in kids.items() if d - radius <= e <= d + radius]


def _local_links(tree_part: list[int], query_part: list[int], radius: int):
    """Links to local component roots among the two parts (all tree values
    against all queries; equal parts: among themselves)."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree = BKTree()
    for x in tree_part:
        tree.add(x)
    for x in query_part:
        for at in tree.near(x, radius):
            a, b = find(x), find(tree.values[at])
            if a != b:
                root[max(a, b)] = min(a, b)
    return [(x, r) for x in root if (r := find(x)) != x]


def _block_keys(radius: int) -> Column:
    """A 64-bit shard key per pair of the radius + 2 blocks of bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(F.col("fp"), 64 - cuts[i + 1]), 64 - (cuts[i + 1] - cuts[i]))
            for i in range(n)]
    pairs = itertools.combinations(range(n), 2)
    return F.array(*[F.xxhash64(F.lit(k), part[i], part[j]) for k, (i, j) in enumerate(pairs)])


def links(prints: DataFrame, radius: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose components
    are those of all pairs within ``radius`` bits."""
    rows = prints.select("fp").distinct().select("fp", F.explode(_block_keys(radius)).alias("key"))
    rows = materialise(rows, "shard-rows")
    counts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select("key", F.ceil(F.col("n") / shard).cast("int").alias("parts")), "shard-sizes")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    dealt = rows.join(counts, "key").withColumn("own", own)
    # tree i meets the queries of part j >= i; a fingerprint is in part `own`
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def search(batches):
        def done(group, key):
            tree = [f for o, f in group if o == key[1]]
            queries = [f for o, f in group if o == key[2]]
            return _local_links(tree, queries, radius)

        key, group, out = None, [], []
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(4)]
            fps = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for k, i, j, o, f in zip(*cols, fps):
                if (k, i, j) != key:
                    if len(group) > 1:
                        out += done(group, key)
                    key, group = (k, i, j), []
                group.append((o, f))
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if len(group) > 1:
            out += done(group, key)
        if out:
            yield _batch(out)

    def _batch(out):
        ab = np.array(out, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return (dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(search, "a long, b long"))


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of ``docs``; root names
    the component, component_id is the smallest doc_id in it."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    folded = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "folded")
    stars = components(links(folded, radius))
    rooted = folded.join(stars, folded["fp"] == stars["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def query(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that with the
    smallest doc_id (rows sharing it: the smallest text hash; equal rows: one)."""
    found = materialise(groups(docs, shingle, radius), "groups")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "copies")).alias("f"))
    first = materialise(first.select("f.*"), "first")
    others = rows.join(first, same(rows, first, "doc_id", "text_hash"), "left_anti")
    others = materialise(others.select("doc_id", "text_hash"), "others")

    def matches(gone):
        return (docs["doc_id"].cast("long").eqNullSafe(gone["doc_id"])
                & (F.xxhash64(whole_text(docs["text"])) == gone["text_hash"]))

    twice = first.where("copies > 1")
    if twice.isEmpty():
        return docs.join(others, matches(others), "left_anti")
    # equal rows of a kept document: one of them, found among those rows alone
    rest = docs.join(others, matches(others), "left_anti").join(twice, matches(twice), "left_anti")
    return rest.unionByName(docs.join(twice, matches(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
