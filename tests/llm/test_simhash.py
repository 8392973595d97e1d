import random

import xxhash

from bibliospark.llm import simhash
from bibliospark.llm.common import components


def brute_fp(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=2):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_whole_table_against_brute_force(spark):
    SF001 = "/root/testdata/sf0.001"
    from bibliospark.sources.tables import table
    docs = table(spark, SF001, "documents")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = {d: (f"{fps[d]:016x}", c) for d, c in brute_groups(fps).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(docs).collect()}
    assert got == want


def test_links_of_planted_fingerprints_in_small_shards(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = {b for b in base}
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rnd.choice((1, 2, 3, 5))):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {}
    for f, g in zip(signed, [f % (1 << 64) for f in signed]):
        want[f] = g
    groups = brute_groups({f: g for f, g in want.items()})
    for shard in (2048, 4):
        stars = {r.node: r.root for r in components(simhash.links(frame, shard=shard)).collect()}
        assert {f: stars.get(f, f) for f in signed} == groups


def test_bk_tree_finds_all_within_radius():
    rnd = random.Random(1)
    values = list({rnd.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        got = {tree.values[k] for k in tree.near(q, 2)}
        assert got == {v for v in values if (v ^ q).bit_count() <= 2}


def test_edge_rows_and_keep_one(docs_of):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    docs = docs_of([(3, None), (1, ""), (2, " \t"), (5, "A b C d e"), (4, "a B c D e"), (4, "a B c D e"),
                    (9, long), (8, long), (None, "other words stand here"), (7, "\x1cone two")])
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.query(docs).collect()}
    zero = "0" * 16
    assert got[(3, zero)] == got[(1, zero)] == got[(2, zero)] == 1
    assert got[(4, f"{brute_fp('a b c d e'):016x}")] == 4
    assert {c for (d, _), c in got.items() if d in (8, 9)} == {8}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 7, 8]
    empty = simhash.query(docs.where("false"))
    assert empty.columns == ["doc_id", "fingerprint", "component_id"] and empty.count() == 0
    assert simhash.keep_one(docs.where("false")).count() == 0
