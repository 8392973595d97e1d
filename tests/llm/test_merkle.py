"""Operator 11 against a straight recursive build, positions of the log, edge rows."""

import zlib
from hashlib import sha256

import pytest

from bibliospark.llm import merkle
from bibliospark.sources.tables import table


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def coded(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree_of(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k:k + 3]) for k in range(0, len(last), 3)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1:first + 3]))
        i //= 3
    return out


def brute(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0], h(coded(r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[1] for x in by[s]]) for s in names
             if by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1])) is None}
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, leaf, r) in enumerate(by[s]):
            path = beside(trees[s], i) + beside(top, k)
            now = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None:
                now = h(coded((*r[:4], r[4].replace("\n", ""))))
            for a, b in path:
                now = h(*a, now, *b)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], h(*[x for a, b in path for x in a + b]), now,
                        now == top[-1][0]))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_against_the_recursive_build(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
    assert result(merkle.manifest(docs)) == want
    assert {r[-1] for r in want} == {True, False}


def test_many_tiers_and_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 100}", "en", i, f"a\nb {i}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    tiers, trees = merkle.source_trees(docs, high=2)
    assert len(tiers) == 4  # 1000 leaves: 112, 13, 2 and 1 blocks
    assert result(merkle.manifest(docs, high=2)) == brute(rows)
    # the log: every position once, a node behind all nodes below it
    log = {}
    for r in merkle.nodes(tiers, trees.select("tree", "size"), high=2).collect():
        assert log.setdefault(r.tree, {}).setdefault(r.position, r.digest) == r.digest
    for t in trees.collect():
        sizes, n = 0, t["size"]
        while True:
            sizes, n = sizes + n, -(-n // 3) if n > 1 else 0
            if not n:
                break
        assert sorted(log[t.tree]) == list(range(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 82])
def test_addresses_follow_completion(n):
    levels = tree_of([h(str(i)) for i in range(n)])
    log = merkle.complete(levels[0], merkle.height(n))
    assert len(log) == sum(map(len, levels))
    for level, row in enumerate(levels):
        for index, digest in enumerate(row):
            assert log[merkle.address(level, index, n)] == digest
    for i in range(n):
        path = [("".join(a), "".join(b)) for a, b in beside(levels, i)]
        assert list(merkle.siblings(log, i, n, merkle.height(n))) == path
        assert list(merkle._read(merkle._written(path))) == path
        assert merkle.fold(levels[0][i], path) == levels[-1][0]


def test_edge_rows(spark, docs_of):
    long = "zeile\n" * 60_000
    rows = [(3, None, "b"), (3, None, "b"), (3, "x\ny", "b"), (None, "n\nn", "b"), (1, "", None), (2, "é\nü", None),
            (5, "alone", "é"), (6, long, "Z"), (7, long, "Z"), (8, "a\n\nb", "Z")]
    docs = docs_of(rows)
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result(got) == brute([(r[0], r[2], "en", None, r[1]) for r in rows])
    one = docs.where("doc_id = 5")
    assert result(merkle.manifest(one)) == brute([(5, "é", "en", None, "alone")])
    assert result(merkle.manifest(one))[0][4] == sha256(b"").hexdigest()
    assert merkle.manifest(docs.where("false")).count() == 0
