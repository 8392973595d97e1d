"""Operator 6, line dedup: segment-partition edit join.

Every line with a word has a class. Lines of at least ``MIN_CHARS`` code points
are linked when their edit distance is at most t, shorter ones when they are
equal (two edits make another heading or number of them). A line of length l is cut into t + 1 segments; a line
within t edits, of length l to l + t, holds one of them unchanged near its
place. So every line posts its own segments (the index) and, for each shorter
length, the few substrings that can be such a segment (the probes; places
bounded from both ends). Lines that meet under a substring key are compared by
letter counts and then by banded bit-parallel edit distance. Linked lines form
classes; of a class the first line (smallest doc_id, then line) stays.

Plan: keys travel as packed 16-byte records, dealt by key over buckets sized
from the input's partitions; a line that a task has seen before posts nothing,
so a line shared by many documents is pre-aggregated. Only keys that two
different lines post leave their bucket. A key with more than ``BLOCK`` lines
is cut into blocks, and each pair of blocks is a task group of its own: no
group is unbounded and pairs are not rows (a block yields its lines' local
class roots and link counts). Texts join only for the lines of shared keys.

Defined cases: null text is one empty line; lines of white space alone have no
row; ``strip_lines`` leaves lines under ``MIN_CHARS`` where they are; the order of documents is that of doc_id, nulls last; rows with one doc_id count
as one document, so equal rows keep the same lines. Equal lines are known by
64-bit hash and length. Other columns are left as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE_SPACE, Dealer, buckets_for, components, let, materialise, small_batches, space_words, whole_text
from .quality_rules import MIN_WORDS

MAX_EDITS = 2
MIN_CHARS = 40
#: A document that loses lines goes when it keeps less than this share of its
#: characters and fewer words than the quality rules ask: what is left of a copy
#: is a fragment.
MIN_LEFT = 0.2
#: Lines of one key compared in one task group.
BLOCK = 1024
#: Rows whose 8-byte ids may be broadcast (16 MB); beyond it, a shuffle join.
BROADCAST_ROWS = 2_000_000
#: Line hashes a task remembers to skip repeats.
SEEN = 1_000_000
BUCKETS_PER_PARTITION = 6


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of the edits + 1 segments, the longer ones last."""
    n, long = divmod(length, edits + 1)
    out, at = [], 0
    for k in range(edits + 1):
        size = n + (k > edits - long)
        out.append((at, size))
        at += size
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, bool]]:
    """(seed, start, size, indexed) of every substring a line of this length
    posts; the seed holds indexed length and segment, indexed marks its own segments."""
    out = []
    for less in range(edits + 1):
        for k, (at, size) in enumerate(segments(length - less, edits)):
            low = max(at - k, at + less - (edits - k), 0)
            high = min(at + k, at + less + (edits - k), length - size)
            out += [((length - less) * (edits + 1) + k, p, size, less == 0 and p == at)
                    for p in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: a band of 2 * edits + 1
    diagonals, its vertical differences held in two bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    low, high = 0, len(a)  # strip the common prefix, then the common suffix
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, len(a)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[-mid:] == b[-mid:] else (low, mid - 1)
    a, b = a[:len(a) - low], b[:len(b) - low]
    if len(b) <= edits:
        return True
    if not a or len(a) <= edits:  # too short for a band: the plain recurrence
        row = list(range(len(a) + 1))
        for j, y in enumerate(b, 1):
            last, row[0] = row[0], j
            for i, x in enumerate(a, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
        return row[-1] <= edits
    width = 2 * edits + 1
    mask = (1 << width) - 1
    up, down = (mask >> edits) << edits, 0  # bit k: row j - edits + k is larger, smaller than the row above
    distance, bottom = edits, 1 << (width - 1)
    for j, y in enumerate(b, 1):
        first = j - edits
        match = 0
        for k in range(max(0, 1 - first), min(width, len(a) - first + 1)):
            if a[first + k - 1] == y:
                match |= 1 << k
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = (down | ~(diagonal | up)) & mask
        right_down = diagonal & up
        if j <= len(a) - edits:
            distance += not diagonal & bottom
        else:
            at = 1 << (len(a) - j + edits)
            distance += bool(right_up & at) - bool(right_down & at)
        up = (right_down | ~((diagonal >> 1) | right_up)) & mask
        down = (diagonal >> 1) & right_up
    return distance <= edits


def _first_key(index: str, probe: str, edits: int):
    """The first (seed, start, size) by which the probe meets the index line."""
    segs = segments(len(index), edits)
    for seed, p, size, _ in probes(len(probe), edits):
        length, k = divmod(seed, edits + 1)
        if length == len(index) and probe[p:p + size] == index[segs[k][0]:segs[k][0] + size]:
            return seed, probe[p:p + size]
    return None


def _key(seed: int, part: str) -> int:
    return xxhash.xxh3_64_intdigest(part.encode(), seed) & ~1


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, line_no, line_id, chars, line) of every line long enough
    (0: of every line with a word)."""
    return (docs.select("doc_id", F.xxhash64(whole_text("text")).alias("text_hash"),
                        F.posexplode(F.split(whole_text("text"), "\n")).alias("line_no", "line"))
            .withColumn("chars", F.length("line")).where(F.col("chars") >= min_chars)
            .where(F.lit(min_chars > 0) | (F.translate("line", WHITE_SPACE, "") != ""))
            .select("doc_id", "text_hash", "line_no", F.xxhash64("line", "chars").alias("line_id"), "chars", "line"))


def _shared_keys(lines: DataFrame, edits: int, block: int, buckets: int) -> DataFrame:
    """(key, i, j, own, indexed, line_id): the lines of every key that two
    different lines post, one of them as its index, dealt to pairs of blocks."""
    def post(batches):
        plans, seen, dealer = {}, set(), Dealer(buckets)
        for b in batches:
            keys, ids = [], []
            for line_id, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if line_id in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(line_id)
                plan = plans.get(len(line))
                if plan is None:
                    plan = probes(len(line), edits)
                    if len(plans) < 10_000:
                        plans[len(line)] = plan
                for seed, p, n, indexed in plan:
                    keys.append(_key(seed, line[p:p + n]) | indexed)  # the lowest bit marks the index
                ids += [line_id] * len(plan)
            if keys:
                record = np.empty((len(keys), 2), np.uint64)
                record[:, 0] = np.array(keys, np.uint64)
                record[:, 1] = np.array(ids, np.int64).view(np.uint64)
                dealer.add(record, record[:, 0])
            yield from dealer.full()
        yield from dealer.rest()

    def meet(table):
        record = Dealer.read(table, 2)
        record = record[np.lexsort((record[:, 1], record[:, 0]))]
        record = record[np.concatenate(([True], (np.diff(record, axis=0) != 0).any(axis=1)))]
        key = record[:, 0] & ~np.uint64(1)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((start, [len(key)])))
        run = np.repeat(np.arange(len(start)), count)
        # an index line and a different line: not all records have the index line's id
        has_index = np.bitwise_or.reduceat(record[:, 0] & np.uint64(1), start) > 0
        differ = np.minimum.reduceat(record[:, 1], start) != np.maximum.reduceat(record[:, 1], start)
        keep = (has_index & differ)[run]
        record, key, run = record[keep], key[keep], run[keep]
        place = np.arange(len(run)) - np.searchsorted(run, run)
        parts = -(-count[run] // block) if len(run) else np.zeros(0, np.int64)
        own = place % np.maximum(parts, 1)
        again = np.repeat(np.arange(len(run)), parts)
        other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts) if len(run) else again
        i, j = np.minimum(own[again], other), np.maximum(own[again], other)
        return pa.table([pa.array(key[again].view(np.int64)), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                         pa.array(own[again], pa.int32()), pa.array((record[again, 0] & np.uint64(1)) > 0),
                         pa.array(record[again, 1].view(np.int64))],
                        ["key", "i", "j", "own", "indexed", "line_id"])

    return (lines.select("line_id", "line").mapInArrow(post, Dealer.SCHEMA)
            .groupBy("bucket").applyInArrow(meet, "key long, i int, j int, own int, indexed boolean, line_id long"))


def _counts(lines: list[str]) -> np.ndarray:
    out = np.zeros((len(lines), 32), np.int32)
    for k, x in enumerate(lines):
        codes = np.frombuffer(x.encode("utf-32-le"), "<u4")
        out[k] = np.bincount(codes & 31, minlength=32)
    return out


def _compare(rows, key, edits):
    """Links of one block pair: for each line its local root and its links
    (each link counted at the first key of the pair alone)."""
    k, i, j = key
    index = [r for r in rows if r[1]]
    counts = _counts([r[3] for r in index]) if len(index) > 8 and len(rows) > 8 else None
    root, links = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for own, _, line_id, line in rows:
        if counts is None:
            near = index
        else:
            codes = np.frombuffer(line.encode("utf-32-le"), "<u4")
            off = np.abs(counts - np.bincount(codes & 31, minlength=32)).sum(axis=1)
            near = [index[x] for x in np.flatnonzero(off <= 2 * edits).tolist()]
        for other_own, _, other_id, other in near:
            if other_id == line_id or i != j and other_own == own or len(other) > len(line) \
                    or len(other) == len(line) and other_id > line_id or not within(other, line, edits):
                continue
            first = _first_key(other, line, edits)
            if first is None or _key(*first) != k:
                continue
            a, b = find(line_id), find(other_id)
            root[max(a, b)] = min(a, b)
            links[line_id] = links.get(line_id, 0) + 1
            links[other_id] = links.get(other_id, 0) + 1
    return [(x, find(x), n) for x, n in links.items()]


def links(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS,
          block: int = BLOCK) -> DataFrame:
    """(line_id, root, n_links): per block, a line's local class root and the
    links counted there; n_links over all rows of a line is its number of
    different lines within ``edits``."""
    if min_chars <= edits * (edits + 1):
        raise ValueError("lines must be longer than edits * (edits + 1) characters")
    small_batches(docs.sparkSession)
    lines = lines_of(docs, min_chars)
    buckets = buckets_for(docs, BUCKETS_PER_PARTITION)
    shared = materialise(_shared_keys(lines, edits, block, buckets), "shared-keys")
    ids = materialise(shared.select("line_id").distinct(), "shared-lines")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = materialise(lines.select("line_id", "line").join(wanted, "line_id", "left_semi")
                        .dropDuplicates(["line_id"]), "shared-texts")
    dealt = shared.join(texts, "line_id").select("key", "i", "j", "own", "indexed", "line_id", "line")

    def verify(batches):
        key, rows, out = None, [], []
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if r[:3] != key:
                    if len(rows) > 1:
                        out += _compare(rows, (key[0] % (1 << 64), *key[1:]), edits)
                    key, rows = r[:3], []
                rows.append(r[3:])
            if len(out) > 10_000:
                yield _found(out)
                out = []
        if len(rows) > 1:
            out += _compare(rows, (key[0] % (1 << 64), *key[1:]), edits)
        yield _found(out)

    def _found(out):
        cols = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["line_id", "root", "n_links"])

    return materialise(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                       .mapInArrow(verify, "line_id long, root long, n_links long"), "line-links")


def classes(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, block: int = BLOCK,
            shortest: int | None = None) -> DataFrame:
    """One row per line long enough (of at least ``shortest`` characters, if
    given, those under ``min_chars`` classed by equality alone; 0: every line with
    a word): doc_id, text_hash, line_no, chars, class_doc_id and class_line_no (the class's first line), n_links (different
    lines within ``edits``), removed (not the first of its class)."""
    found = links(docs, edits, min_chars, block)
    stars = components(found.select(F.col("line_id").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("line_id").agg(F.sum("n_links").alias("n_links"))
    linked = materialise(counted.join(stars, counted["line_id"] == stars["node"], "left")
                         .select("line_id", F.coalesce("root", "line_id").alias("class"), "n_links"), "linked")
    small = linked.count() <= BROADCAST_ROWS
    lines = lines_of(docs, min_chars if shortest is None else shortest).drop("line")
    lines = (lines.join(F.broadcast(linked) if small else linked, "line_id", "left")
             .select("doc_id", "text_hash", "line_no", "chars", F.coalesce("class", "line_id").alias("class"),
                     F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    lines = materialise(lines, "classed-lines")
    firsts = lines.groupBy("class").agg(F.min("doc_id").alias("class_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = materialise(firsts.select(F.col("class").alias("of"), "class_doc_id"), "class-documents")
    joined = lines.join(firsts, F.col("class") == F.col("of"))
    first_lines = (joined.where(F.col("doc_id").eqNullSafe(F.col("class_doc_id")))
                   .groupBy("of", "class_doc_id").agg(F.min("line_no").alias("class_line_no")))
    first_lines = materialise(first_lines, "class-lines")
    own = F.col("of").isNull()
    out = lines.join(first_lines, F.col("class") == F.col("of"), "left")
    return out.select("doc_id", "text_hash", "line_no", "chars",
                      F.when(own, F.col("doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
                      F.when(own, F.col("line_no")).otherwise(F.col("class_line_no")).alias("class_line_no"), "n_links",
                      (~own & ~(F.col("doc_id").eqNullSafe(F.col("class_doc_id"))
                                & (F.col("line_no") == F.col("class_line_no")))).alias("removed"))


def strip_lines(docs: DataFrame, min_left: float = MIN_LEFT, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without the removed lines; n_chars,
    if there, follows the text. Documents that lost lines and keep no words, or
    fewer than ``MIN_WORDS`` and under ``min_left`` of their characters (white
    space aside), go."""
    gone = (classes(docs, **options).where("removed").select("doc_id", "text_hash", "line_no").distinct()
            .groupBy("doc_id", "text_hash").agg(F.collect_list("line_no").alias("gone")))
    gone = materialise(gone.select(F.col("doc_id").alias("\0doc"), F.col("text_hash").alias("\0hash"),
                                   F.col("gone").alias("\0gone")), "gone-lines")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(gone["\0doc"])
                       & (F.xxhash64(whole_text(docs["text"])) == gone["\0hash"]), "left")

    def rest(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("\0gone"))
        return F.array_join(F.transform(left, lambda k: F.get(lines, k)), "\n")

    text = F.when(F.col("\0gone").isNull(), docs["text"]).otherwise(
        let(F.split(whole_text(docs["text"]), "\n"), rest))
    before = F.length(F.translate(whole_text(docs["text"]), WHITE_SPACE, ""))
    left = F.length(F.translate(F.col("text"), WHITE_SPACE, ""))
    out = (joined.withColumn("\0before", before).withColumn("text", text)
           .where(F.col("\0gone").isNull() | ((left > 0) & ((left >= F.col("\0before") * min_left)
                                                        | (F.size(space_words(F.col("text"))) >= MIN_WORDS)))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("\0gone").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return classes(docs, shortest=0).drop("text_hash")
