"""Operator 13 against all pairs of whole shingle sets, and its steps alone."""

import random

import numpy as np
import pytest

from bibliospark.llm import minhash
from bibliospark.llm.common import components
from bibliospark.sources.tables import table


def brute_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not words:
        return set()
    return {b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}


def brute(rows, percent=85):
    """(doc_id, n, component, kept) of (doc_id, text) rows, all pairs compared."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((x for x in low[find(i)] if x is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table_against_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(minhash.query(docs)) == want
    assert 0 < sum(not r[3] for r in want) < len(want)


def chains(rnd, n, words, edits):
    """Texts that drift: each is a few words off the one before."""
    text = [f"w{rnd.randrange(10_000)}" for _ in range(words)]
    for _ in range(n):
        yield " ".join(text)
        for _ in range(edits):
            text[rnd.randrange(words)] = f"w{rnd.randrange(10_000)}"


def test_chains_and_large_groups_in_small_blocks(spark):
    rnd = random.Random(7)
    texts = [t for k in range(6) for t in chains(rnd, 40, 120, 3 + k)]
    hub = [f"h{i}" for i in range(150)]
    for _ in range(150):  # a large group: all near one text, hardly near each other
        x = list(hub)
        for _ in range(rnd.randrange(1, 6)):
            x[rnd.randrange(150)] = f"x{rnd.randrange(10_000)}"
        texts.append(" ".join(x))
    for _ in range(60):  # alike, but no near copies: candidates that must all be refused
        x = list(hub[:80])
        for _ in range(8):
            x[rnd.randrange(80)] = f"y{rnd.randrange(10_000)}"
        texts.append(" ".join(x))
    rows = [(k, t) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for block in (512, 8):
        got = minhash.near_duplicates(docs, block_sets=block)
        assert result(got.select("doc_id", "n_shingles", "component_id", "kept")) == want


def test_links_at_the_threshold(spark):
    # 170 of 200 shingles shared: just linked; 169 of 200: not
    base = [f"a{i}" for i in range(187)]
    on, off = base[:172] + [f"b{i}" for i in range(15)], base[:171] + [f"c{i}" for i in range(16)]
    rows = [(1, " ".join(base)), (2, " ".join(on)), (3, " ".join(off))]
    a, b, c = (brute_set(t) for _, t in rows)
    assert 100 * len(a & b) == 85 * len(a | b) and 100 * len(a & c) < 85 * len(a | c)
    assert result(minhash.query(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert minhash.linked(np.arange(170, dtype=np.uint64), np.arange(200, dtype=np.uint64))
    assert not minhash.linked(np.arange(169, dtype=np.uint64), np.arange(200, dtype=np.uint64))


def test_coordinates_agree_as_often_as_the_sets(spark):
    rnd = np.random.default_rng(5)
    for share in (0.5, 0.85):
        agreed = []
        for _ in range(60):
            u = rnd.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * share)
            a, b = u[:n + (400 - n) // 2], np.concatenate([u[:n], u[n + (400 - n) // 2:]])
            agreed.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert np.mean(agreed) == pytest.approx(share, abs=0.02)
    # the second permutation is one: no two values meet
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(40503)
    assert len(np.unique(minhash._permuted(x.copy(), 0x85EBCA6B, 0xC2B2AE35))) == len(x)


def test_edge_rows(docs_of):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(3, None), (1, ""), (2, " \t"), (5, "A b C d e"), (4, "a B c D e"), (4, "a B c D e"), (9, long),
            (8, long + " end"), (None, "other words stand here"), (None, "Other words stand here"), (7, "\x1cone two"),
            (6, "\x1cONE two"), (None, "quite alone"), (None, None), (10, "two words"), (11, "words two")]
    docs = docs_of(rows)
    got = minhash.query(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(d, n, c, d == c) for d, n, c, _ in brute(rows)]
    assert result(got) == sorted(want, key=repr)
    empty = minhash.query(docs.where("false"))
    assert empty.columns == got.columns and empty.count() == 0
    nothing = minhash.query(docs.where("doc_id in (1, 2, 3)"))
    assert result(nothing) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
