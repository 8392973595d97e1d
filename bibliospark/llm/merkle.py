"""Operator 11, Merkle dataset manifest: a postorder append log.

Every row is a leaf; per source the leaves ascend by doc_id, and every three
consecutive nodes become their hash until one is left, the subroot. The
subroots, ordered by source, form the root in the same way.

Aligned builders cut a source into blocks of 3^6 leaves. A builder
writes the nodes of its block in the order of their completion (postorder), so
no position is stored: leaf i stands behind the i leaves and all complete nodes
before it, at ``i + i // 3 + i // 9 + ...``, and the node ``(level, index)``
stands ``level`` places behind its last leaf (``address``). The roots of the
blocks are the leaves of the next tier, which is built by the same builders,
until each source has one block; proofs are read from the top tier down, the
siblings of a leaf being addressed in the log of its block.

A source that holds a third of all rows is cut like any other: places are
numbered by range partitions, and a task group is one block. Leaves and logs
are tables in the shared folder; nothing but the one root passes the driver.

Defined cases: a null field is hashed as ``-``; a null source is a source of its
own, the first; equal doc_ids of a source are ordered by leaf (equal rows give
equal leaves, each with its own proof); a null doc_id comes first and is not
tampered with; a lone source with a lone leaf has no siblings, so its proof is
the hash of nothing; an empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import sequence_numbers
from .common import materialise, same, small_batches

ARITY = 3
#: Levels of a builder's block: 3^6 leaves.
HEIGHT = 6
#: Hex digits of a digest.
WIDE = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ------------------------------------------------------------------ leaves --

def _coded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(text: Column) -> Column:
    """The leaf of a row of ``FIELDS`` whose text is ``text``."""
    return F.sha2(F.concat(*[_coded(F.col(c)) for c in FIELDS[:-1]], _coded(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the leaf after the line
    breaks are deleted, or null where nothing is tampered with."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_of(F.col("text")).alias("leaf"),
        F.when(chosen & F.col("text").contains("\n"), leaf_of(F.translate("text", "\n", ""))).alias("tampered"))


# --------------------------------------------------------------------- log --

def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


def leaf_position(i: int) -> int:
    """Postorder position of leaf ``i``."""
    at = 0
    while i:
        at, i = at + i, i // ARITY
    return at


def address(level: int, index: int, n: int) -> int:
    """Postorder position of a node in a tree over ``n`` leaves: the nodes that
    its last leaf completes follow that leaf, one a level."""
    return leaf_position(min((index + 1) * ARITY ** level, n) - 1) + level


def complete(digests: list[str], levels: int) -> list[str]:
    """The log of a block: its nodes in the order of their completion."""
    log, runs = [], [[] for _ in range(levels + 1)]
    for i, digest in enumerate(digests, 1):
        level = 0
        log.append(digest)
        runs[0].append(digest)
        while level < levels and (len(runs[level]) == ARITY or i == len(digests)):
            digest = sha256("".join(runs[level]).encode()).hexdigest()
            runs[level] = []
            level += 1
            log.append(digest)
            runs[level].append(digest)
    return log


def _cut(text: str) -> list[str]:
    return [text[k:k + WIDE] for k in range(0, len(text), WIDE)]


def siblings(log: list[str], i: int, n: int, levels: int):
    """(left, right) digests beside leaf ``i`` and its ancestors, level by level."""
    for level in range(levels):
        index = i // ARITY ** level
        first = index - index % ARITY
        last = min(first + ARITY, -(-n // ARITY ** level))
        yield ("".join([log[address(level, s, n)] for s in range(first, index)]),
               "".join([log[address(level, s, n)] for s in range(index + 1, last)]))


def _written(path) -> str:
    """A proof as text: the numbers of left and right siblings, then these."""
    return "".join(f"{len(a) // WIDE}{len(b) // WIDE}{a}{b}" for a, b in path)


def _read(text: str):
    at = 0
    while at < len(text):
        a, b = at + 2 + WIDE * int(text[at]), WIDE * int(text[at + 1])
        yield text[at + 2:a], text[a:a + b]
        at = a + b


def fold(leaf: str, path) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf


# ---------------------------------------------------------------- building --

def _pack(rows: DataFrame, keys: list[str], high: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per block of the leaves (*keys, place, digest, *extra): its number
    of leaves ``n``, their digests as one text, and arrays of ``extra``."""
    packed = rows.groupBy(*keys, F.expr(f"place div {ARITY ** high}").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", *extra))).alias("xs"))
    return packed.select(*keys, "block", F.size("xs").alias("n"), F.concat_ws("", F.col("xs.digest")).alias("digests"),
                         *[F.col(f"xs.{c}").alias(c) for c in extra])


def _levels(n: int, many: int, high: int) -> int:
    """Levels that the builder of a block of ``n`` leaves completes: all of a
    whole tree, and those of a full block where the tree has ``many``."""
    return height(n) if many == 1 else high


def _appended(blocks: DataFrame, high: int) -> DataFrame:
    """The table of blocks (tree, block, many, n, digests, ...) with what their
    builders append: ``log`` for ``digests``."""
    names = ["log" if c == "digests" else c for c in blocks.columns]

    def build_logs(batches):
        for b in batches:
            logs = ["".join(complete(_cut(text), _levels(n, many, high))) for many, n, text in
                    zip(*[b.column(c).to_pylist() for c in ("many", "n", "digests")])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(logs, pa.string()) if c == "log" else b.column(c) for c in names], names)

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names, blocks.schema))
    return materialise(blocks.mapInArrow(build_logs, schema), "merkle-log")


def _root() -> Column:
    return F.expr(f"right(log, {WIDE})")


def _blocks_of(size: str, high: int) -> Column:
    return F.ceil(F.col(size) / ARITY ** high).alias("many")


def build(blocks: DataFrame, high: int = HEIGHT) -> list[DataFrame]:
    """The tiers of the trees over packed ``blocks`` (tree, block, many, n,
    digests, ...): tables of logs, the lowest first. ``many`` is the number of
    blocks of the tree in its tier; a tree ends in the tier where it has one."""
    tiers = [_appended(blocks, high)]
    while not (wide := tiers[-1].where("many > 1")).isEmpty():
        up = wide.select("tree", F.col("block").alias("place"), _blocks_of("many", high), _root().alias("digest"))
        tiers.append(_appended(_pack(up, ["tree", "many"], high), high))
    return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """(tree, root) of every tree."""
    return reduce(DataFrame.unionByName, [t.where("many = 1").select("tree", _root().alias("root")) for t in tiers])


def nodes(tiers: list[DataFrame], trees: DataFrame, high: int = HEIGHT) -> DataFrame:
    """The whole append log, a row per node: (tree, position, digest), positions
    counted from 0 in the tree's order of completion. ``trees`` holds (tree,
    size) with the number of leaves."""
    def listed(batches):
        for b in batches:
            out = []
            for tree, size, block, many, n, text, tier in zip(*[c.to_pylist() for c in b.columns]):
                log = _cut(text)
                # the leaves of an upper tier are written in the tier below
                for level in range(1 if tier else 0, _levels(n, many, high) + 1):
                    for index in range(-(-n // ARITY ** level)):
                        whole = block * ARITY ** (high - level) + index
                        out.append((tree, address(level + high * tier, whole, size), log[address(level, index, n)]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["tree", "position", "digest"])

    return reduce(DataFrame.unionByName, [
        t.join(trees, "tree").select("tree", "size", "block", "many", "n", "log", F.lit(k).alias("tier"))
        .mapInArrow(listed, "tree long, position long, digest string") for k, t in enumerate(tiers)])


# ------------------------------------------------------------------ proofs --

def _met(tier: DataFrame, above: DataFrame | None, whole: DataFrame) -> DataFrame:
    """The blocks of a tier with the proof of their root: that of a leaf of the
    tier above, or that of the tree, of which the block is the last one."""
    last = tier.where("many = 1").join(whole.select("tree", "path"), "tree")
    if above is None:
        return last
    return last.unionByName(tier.where("many > 1").join(above, ["tree", "block"]))


def _leaf_proofs(met: DataFrame, high: int) -> DataFrame:
    """(tree, block, path): the proof of every leaf of the blocks, a leaf being
    a block of the tier below."""
    def extract(batches):
        for b in batches:
            out = [(tree, block * ARITY ** high + i, _written(siblings(log, i, n, _levels(n, many, high))) + path)
                   for tree, block, many, n, text, path in zip(*[c.to_pylist() for c in b.columns])
                   for log in [_cut(text)] for i in range(n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["tree", "block", "path"])

    found = met.select("tree", "block", "many", "n", "log", "path").mapInArrow(
        extract, "tree long, block long, path string")
    return materialise(found, "merkle-paths")


def proofs_of_blocks(tiers: list[DataFrame], whole: DataFrame, high: int = HEIGHT) -> DataFrame:
    """The blocks of the lowest tier with their proofs; ``whole`` (tree, path)
    continues the proofs of a tree's nodes beyond its root."""
    above = None
    for tier in reversed(tiers[1:]):
        above = _leaf_proofs(_met(tier, above, whole), high)
    return _met(tiers[0], above, whole)


def _checked(blocks: DataFrame, root: str | None, high: int) -> DataFrame:
    """A row per leaf: its proof, and the root folded from what is stored now."""
    def check(batches):
        for b in batches:
            out = []
            for many, n, text, path, subroot, ids, tampered in zip(*[c.to_pylist() for c in b.columns]):
                log, above, levels = _cut(text), list(_read(path)), _levels(n, many, high)
                for i in range(n):
                    proof = [*siblings(log, i, n, levels), *above]
                    leaf = log[address(0, i, n)]
                    folded = fold(tampered[i] or leaf, proof)
                    digest = sha256("".join([x for pair in proof for x in pair]).encode()).hexdigest()
                    out.append((ids[i], leaf, subroot, root, digest, folded, folded == root))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    return blocks.select("many", "n", "log", "path", "subroot", "doc_id", "tampered").mapInArrow(
        check, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
               "verified boolean")


def source_trees(docs: DataFrame, high: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of the sources' trees, the lowest with arrays doc_id and
    tampered, and the table of trees (source, size, tree)."""
    rows = materialise(leaves(docs), "merkle-leaves")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    trees = materialise(sequence_numbers(sizes, ["source"], out="tree", start=0), "merkle-trees")
    placed = sequence_numbers(rows, ["doc_id", "leaf"], key="source", out="place", start=0)
    packed = _pack(placed.withColumnRenamed("leaf", "digest"), ["source"], high, ("doc_id", "tampered"))
    # the trees' numbers meet the blocks, not the rows
    return build(packed.join(trees, same(packed, trees, "source")).select(
        "tree", "block", _blocks_of("size", high), "n", "digests", "doc_id", "tampered"), high), trees


def manifest(docs: DataFrame, high: int = HEIGHT) -> DataFrame:
    """Leaf, roots and checked proof of every row of ``docs``; ``high`` is the
    number of levels of a block and changes no result."""
    small_batches(docs.sparkSession)
    tiers, trees = source_trees(docs, high)
    subroots = materialise(roots(tiers), "merkle-subroots")
    # the tree of the subroots; a path continues through it to the root
    top = build(_pack(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"),
                                      F.lit(trees.count()).alias("size"), F.col("root").alias("digest")),
                      ["tree", "size"], high).withColumn("many", _blocks_of("size", high)).drop("size"), high)
    root = roots(top).first()
    ends = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit("").alias("path"))
    whole = _leaf_proofs(proofs_of_blocks(top, ends, high), high).select(F.col("block").alias("tree"), "path")
    blocks = proofs_of_blocks(tiers, whole, high).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    return _checked(blocks, root["root"] if root else None, high)


def _sql_fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
                       for c in (*FIELDS[:-1], text))


#: CRC-32 (polynomial EDB88320) of the decimal doc_id in DuckDB, which has no such function.
_SQL_CRC = """list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda x: ascii(x)::UBIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END))"""

SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_sql_fields('text')}) AS leaf,
         CASE WHEN xor({_SQL_CRC}, 4294967295::UBIGINT) % 2 = 0
              THEN sha256({_sql_fields("replace(text, chr(10), '')")}) END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM d),
tree(lvl, t, i, h, n) AS (
  SELECT 0, t, i, leaf, n FROM p
  UNION ALL SELECT lvl + 1, t, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM tree WHERE n > 1 GROUP BY lvl, t, i // 3, n),
sub AS (SELECT t, h FROM tree WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, t, h, (SELECT count(*) FROM sub) FROM sub
  UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3
  FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
nodes AS (SELECT 0 AS part, lvl, t, i, h, n FROM tree UNION ALL SELECT 1, lvl, 0, i, h, n FROM top),
beside AS (SELECT a.part, a.lvl, a.t, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l,
                  coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
           FROM nodes a LEFT JOIN nodes b ON b.part = a.part AND b.lvl = a.lvl AND b.t = a.t AND b.i // 3 = a.i // 3
                AND b.i <> a.i WHERE a.n > 1 GROUP BY ALL),
climb(rid, st, part, lvl, t, i, proof, h) AS (
  SELECT rid, t, 0, 0, t, i, '', coalesce(tampered, leaf) FROM p
  UNION ALL
  SELECT c.rid, c.st, CASE WHEN b.i IS NULL THEN 1 ELSE c.part END, CASE WHEN b.i IS NULL THEN 0 ELSE c.lvl + 1 END,
         CASE WHEN b.i IS NULL THEN 0 ELSE c.t END, CASE WHEN b.i IS NULL THEN c.st ELSE c.i // 3 END,
         c.proof || coalesce(b.l || b.r, ''), CASE WHEN b.i IS NULL THEN c.h ELSE sha256(b.l || c.h || b.r) END
  FROM climb c LEFT JOIN beside b ON b.part = c.part AND b.lvl = c.lvl AND b.t = c.t AND b.i = c.i
  WHERE c.part = 0 OR b.i IS NOT NULL),
ends AS (SELECT rid, arg_max(proof, lvl) AS proof, arg_max(h, lvl) AS h FROM climb WHERE part = 1 GROUP BY rid)
SELECT p.doc_id, p.leaf, sub.h AS subroot, r.h AS root, sha256(ends.proof) AS proof_sha256, ends.h AS folded_root,
       ends.h = r.h AS verified
FROM p JOIN sub ON sub.t = p.t JOIN ends ON ends.rid = p.rid, (SELECT h FROM top WHERE n = 1) r"""
