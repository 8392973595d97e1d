"""Operator 13, MinHash near-dedup: circulant signatures, banding, exact checks.

A document's set is its distinct word shingles. Two permutations of the 32-bit
universe make all ``BANDS * ROWS`` coordinates: the first one scatters the
shingles, the second one, shifted circularly by k, gives coordinate k as the
minimum of ``pi(sigma(x) + k)``. Equal sets (128-bit digest) are folded before
banding; documents that share a band are candidates, and every link is confirmed
on the full sets.

A bucket of m candidates is never listed as pairs. First each member is compared
with the bucket's hub (its smallest id): linked members are done. Only buckets
that still hold several components go on; their members are cut by the size of
their sets into blocks, and every pair of blocks is compared exhaustively in its
own task group, where a link is reported to the root of its local component.
So a group of near copies costs one comparison a member, and unlike members of
a bucket are all compared, whatever its size.

A pair at the threshold 0.85 shares none of the 32 bands of 6 rows with a
probability of (1 - 0.85^6)^32 = 2.7e-7; nothing else can lose a link.

Defined cases: null or empty text and text without words have an empty set and
are linked with nothing, equal ones included; equal rows give equal rows; a null
doc_id belongs to a component and is ignored by its smallest id (a component of
null ids has a null one; kept compares null-safely). Other columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, same, small_batches, whole_text

SHINGLE = 3
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 32, 6
SEED = 42
#: Members compared with one copy of their hub's set.
HUB_BLOCK = 32
#: Bounds of a block of the exhaustive comparison: sets, and shingles in all.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 20
#: Shingles hashed at a time, however long the text.
CHUNK = 2048


# --------------------------------------------------------------- signatures --

def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of one whole text."""
    words = text.encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - shingle + 1, np.uint64)
    for k in range(shingle):  # a polynomial over words' hashes, mixed after every word
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + len(out)])
    return np.unique(out)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permuted(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit universe, in place: xor-shifts and odd factors."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of a set that is not empty, by two permutations."""
    scattered = _permuted((hashes >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(scattered), CHUNK):
        moved = scattered[None, k:k + CHUNK] + shifts  # the second one, shifted circularly
        np.minimum(low, _permuted(moved, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band."""
    parts = low.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, keys) per row of ``docs``; digest
    names the set, an empty one has none."""
    def sign(batches):
        for b in batches:
            sizes, digests, keys = [], [], []
            for text in b.column(2).to_pylist():
                hashes = shingle_set(text, shingle)
                sizes.append(len(hashes))
                digests.append(blake2b(hashes, digest_size=16).digest() if len(hashes) else None)
                keys.append(band_keys(signature(hashes)).view(np.int64) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "digest", "keys"])

    small_batches(docs.sparkSession)
    text = whole_text("text")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        text.alias("text"))
            .mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, digest binary, keys array<bigint>"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(rid, hashes) of the documents named by ``wanted`` (doc_id, text_hash,
    digest, rid), one row each."""
    def make(batches):
        for b in batches:
            found = [(r, d, shingle_set(t, shingle)) for r, d, t in zip(*[c.to_pylist() for c in b.columns])]
            kept = [(r, h.tobytes()) for r, d, h in found if blake2b(h, digest_size=16).digest() == d]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in kept], pa.int64()),
                                              pa.array([h for _, h in kept], pa.binary())], ["rid", "hashes"])

    text = whole_text(docs["text"])
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))
    met = rows.join(wanted, same(rows, wanted, "doc_id", "text_hash")).select("rid", "digest", "text")
    # repeated rows of one document: the same set again
    return materialise(met.mapInArrow(make, "rid long, hashes binary"), "minhash-sets")


# ------------------------------------------------------------------- checks --

def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _hub_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked ones of the pairs (hub, rid): a hub's members in blocks, each
    with one copy of the hub's set, read as a stream."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_BLOCK).alias("parts"))
    dealt = pairs.join(many, "hub").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    rows = dealt.join(sets, "rid").select("hub", "part", "rid", "hashes")
    hubs = many.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hubs = hubs.join(sets, hubs["hub"] == sets["rid"]).select("hub", "part", F.lit(None).cast("long").alias("rid"),
                                                              "hashes")

    def compare(batches):
        at, hub = None, None
        for b in batches:
            out = []
            for h, p, rid, blob in zip(*[c.to_pylist() for c in b.columns]):
                if rid is None:
                    at, hub = (h, p), np.frombuffer(blob, np.uint64)
                elif (h, p) == at and linked(hub, np.frombuffer(blob, np.uint64), percent):
                    out.append((h, rid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["a", "b"])

    return (hubs.unionByName(rows).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("rid"))
            .mapInArrow(compare, "a long, b long"))


def _group_links(left: list, right: list, within: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels among members (rid, label, set): between
    the two blocks, or within the one."""
    if len({label for _, label, _ in (*left, *right)}) < 2:
        return []
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(h) for _, _, h in left])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, places = np.unique(np.concatenate([h for _, _, h in left]), return_inverse=True)
    mark, out = np.zeros(len(values), bool), []
    for k, (rid, label, h) in enumerate(right):
        n = k if within else len(left)
        if not n:
            continue
        at = np.minimum(np.searchsorted(values, h), len(values) - 1)
        at = at[values[at] == h]
        mark[at] = True
        both = np.add.reduceat(mark[places], starts, dtype=np.int64)[:n]
        mark[at] = False
        for j in np.flatnonzero(100 * both >= percent * (sizes[:n] + len(h) - both)).tolist():
            a, b = find(left[j][1]), find(label)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((left[j][0], rid))
    return out


def _block_links(members: DataFrame, sets: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """Links between different labels of each group (group, rid, label, n), all
    pairs compared: a group is cut into blocks, and block i meets block j >= i in
    a task group of their own."""
    parts = members.groupBy("group").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    dealt = members.join(parts, "group").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = dealt.join(sets, "rid").select("group", F.least("own", "other").alias("i"),
                                          F.greatest("own", "other").alias("j"), "own", "rid", "label", "hashes")

    def compare(batches):
        def done(key, held):
            left, right = [x[1:] for x in held if x[0] == key[1]], [x[1:] for x in held if x[0] == key[2]]
            return _group_links(left, right, key[1] == key[2], percent) if left and right else []

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["a", "b"])

        key, held = None, []
        for b in batches:
            out = []
            for g, i, j, own, rid, label, blob in zip(*[c.to_pylist() for c in b.columns]):
                if (g, i, j) != key:
                    out += done(key, held) if held else []
                    key, held = (g, i, j), []
                held.append((own, rid, label, np.frombuffer(blob, np.uint64)))
            if out:
                yield batch(out)
        if out := (done(key, held) if held else []):
            yield batch(out)

    return (rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
            .mapInArrow(compare, "a long, b long"))


# --------------------------------------------------------------- components --

def _labelled(links: DataFrame, name: str) -> DataFrame:
    return materialise(components(links).select(F.col("node").alias("rid"), F.col("root").alias("label")), name)


def clusters(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
             block_sets: int = BLOCK_SETS) -> DataFrame:
    """(rid, label) of the sets that are linked with another one. ``reps``: one
    row per distinct set (rid, n, keys, doc_id, text_hash, digest)."""
    banded = reps.select("rid", "n", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rid").alias("hub"),
                                     F.min_by("n", "rid").alias("hub_n")).where("size > 1")
    shared = materialise(banded.join(hubs, "key"), "minhash-buckets")
    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = materialise(shared.where((F.col("rid") != F.col("hub")) & near).select("hub", "rid").distinct(),
                        "minhash-pairs")
    # candidates alone make their sets once more, from their whole texts
    asked = shared.select("rid").distinct()
    sets = _sets(docs, reps.join(asked, "rid", "left_semi").select("doc_id", "text_hash", "digest", "rid"), shingle)
    if not sets.groupBy("rid").count().where("count > 1").isEmpty():
        sets = materialise(sets.dropDuplicates(["rid"]), "minhash-sets")
    links = materialise(_hub_links(pairs, sets, percent), "minhash-links")
    labels = _labelled(links, "minhash-labels")
    # buckets of three or more that are not one component yet; equal ones once
    known = shared.where("size > 2").join(labels, "rid", "left").select(
        "key", "rid", "n", F.coalesce("label", "rid").alias("label"))
    known = materialise(known, "minhash-known")
    mixed = known.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64(F.lit(1), "rid").cast("decimal(38,0)")).alias("s"))
    mixed = mixed.where("low <> high").groupBy("size", "x", "s").agg(F.min("key").alias("key"))
    members = materialise(known.join(mixed.select("key"), "key").withColumnRenamed("key", "group"), "minhash-members")
    if members.isEmpty():
        return labels
    more = materialise(_block_links(members, sets, percent, block_sets), "minhash-links")
    return _labelled(links.unionByName(more), "minhash-labels")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    block_sets: int = BLOCK_SETS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) per row of ``docs``."""
    signed = materialise(prints(docs, shingle), "minhash-prints")
    full = signed.where("digest is not null")
    # one row of each set names it: that of the smallest doc_id
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    reps = full.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("text_hash", order).alias("text_hash"),
        F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    reps = materialise(reps.withColumn("rid", F.monotonically_increasing_id()), "minhash-reps")
    labels = clusters(docs, reps, shingle, percent, block_sets)
    rooted = materialise(reps.select("rid", "digest", F.col("doc_id").alias("low")).join(labels, "rid", "left").select(
        "digest", "low", F.coalesce("label", "rid").alias("label")), "minhash-rooted")
    ids = rooted.groupBy("label").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.join(ids, "label").select("digest", "component_id"), "minhash-named")
    found = full.join(named, "digest").select("doc_id", "text_hash", "n_shingles", "component_id")
    lone = signed.where("digest is null").select("doc_id", "text_hash", "n_shingles",
                                                 F.col("doc_id").alias("component_id"))
    return found.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
