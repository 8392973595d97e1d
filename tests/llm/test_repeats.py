import hashlib
import random
from collections import Counter

from bibliospark.llm import repeats


def brute(rows, length=400):
    """{row number: (n_bytes, n_removed, n_spans, sha256)}"""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, raw):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        rest = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def planted(rnd):
    passages = [sentence(rnd, 90) for _ in range(6)] + [sentence(rnd, 200)]
    rows = []
    for d in range(60):
        parts = [sentence(rnd, rnd.randrange(5, 60))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 120)
            parts += [p[a:a + rnd.choice((380, 399, 405, 450, 2000))], sentence(rnd, rnd.randrange(30))]
        rows.append((d, "".join(parts)))
    copy = sentence(rnd, 300)
    rows += [(100 + i, copy) for i in range(5)]
    for i in range(30):  # near copies: words replaced anywhere
        words = copy.split()
        for _ in range(3):
            words[rnd.randrange(len(words))] = "zz"
        rows.append((200 + i, " ".join(words)))
    rows += [(300, "En " * 700), (301, "x" * 1500), (302, None), (303, ""), (304, "y" * 400), (305, "z" * 401),
             (306, "q" * 399), (307, "same row " * 3), (307, "same row " * 3), (308, copy[:410]), (308, copy[:410]),
             (None, copy[100:700]), (None, "null id")]
    return rows


def test_bytes_against_brute_force(docs_of):
    rows = planted(random.Random(11))
    want = brute(rows)
    for block in (4096, 3):
        got = repeats.query(docs_of(rows)).collect() if block == 4096 else \
            repeats.judge(docs_of(rows), block=block).drop("spans").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want
    assert repeats.query(docs_of([])).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((tuple(r) for r in repeats.query(docs).collect()), key=repr) == want


def test_long_text_hashes_in_steps(monkeypatch):
    import numpy as np
    data = np.frombuffer(sentence(random.Random(1), 2000).encode(), np.uint8)
    whole = repeats.gram_hashes(data)
    monkeypatch.setattr(repeats, "_STEP", 1000)
    assert (repeats.gram_hashes(data) == whole).all()
    assert len(set(whole.tolist())) == len({bytes(data[i:i + 48]) for i in range(len(data) - 47)})


def test_planted_passages_are_removed_and_clean_documents_left_alone(docs_of):
    rnd = random.Random(31)
    long = [sentence(rnd, 140) for _ in range(8)]  # each over 50 words and over 400 bytes
    short = [" ".join(rnd.choice("abcdefgh") * 2 for _ in range(52)) for _ in range(4)]  # over 50 words, under 400 bytes
    assert all(len(p.encode()) >= 450 for p in long) and all(len(p) < 400 for p in short)
    rows, planted_ids = [], set()
    for d in range(120):
        parts = [sentence(rnd, rnd.randrange(20, 200)), "", sentence(rnd, rnd.randrange(20, 200))]
        if d < 50:
            parts[1] = long[d % 8]
            planted_ids.add(d)
        elif d < 70:
            parts[1] = short[d % 4]
        rows.append((d, " ".join(parts)))
    got = {r.doc_id: r for r in repeats.query(docs_of(rows)).collect()}
    # read by n_removed: every passage of 400 bytes or more, and nothing else
    assert {d for d, r in got.items() if r.n_removed} == planted_ids
    assert all(got[d].n_removed >= len(long[d % 8].encode()) for d in planted_ids)
