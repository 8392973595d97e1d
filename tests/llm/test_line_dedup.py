import random

import pytest

from bibliospark.llm import line_dedup


def lev(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        last, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, text, n, letters):
    b = list(text)
    for _ in range(n):
        k, how = rnd.randrange(len(b) + 1), rnd.randrange(3)
        if how == 0 or k == len(b):
            b.insert(k, rnd.choice(letters))
        elif how == 1:
            b.pop(k)
        else:
            b[k] = rnd.choice(letters)
    return "".join(b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_segments(edits):
    rnd = random.Random(edits)
    for _ in range(4000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(18)))
        b = edited(rnd, a, rnd.randrange(1, 5), "ab")
        near = lev(a, b) <= edits
        assert line_dedup.within(a, b, edits) == near
        x, y = sorted((a, b), key=len)
        if near and len(x) > edits * (edits + 1):
            assert line_dedup._first_key(x, y, edits)


def brute(docs, edits, min_chars):
    """{(doc_id, line_no): (first of class, links, removed)}"""
    at = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if len(x) >= min_chars]
    texts = sorted({x for _, _, x in at})
    root, n = {x: x for x in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if abs(len(a) - len(b)) <= edits and lev(a, b) <= edits:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first = {}
    for d, i, x in at:
        first[find(x)] = min(first.get(find(x), (d, i)), (d, i))
    return {(d, i): (*first[find(x)], n[x], first[find(x)] != (d, i)) for d, i, x in at}


@pytest.mark.parametrize("block", [1024, 3])
def test_classes_against_brute_force(docs_of, block):
    rnd = random.Random(7)
    words = ["alpha", "beta", "of", "the", "gamma", "straße", "né"]
    base = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(25)]
    docs = []
    for d in range(60):
        lines = [edited(rnd, x, rnd.choice((0, 0, 1, 2, 3)), "xyzé ") for x in rnd.sample(base, 5)]
        docs.append((d, "\n".join(lines + ["short", ""])))
    docs += [(100 + i, "\n".join(f"the very same template line with number {i:03d} and more words " for _ in range(2)))
             for i in range(30)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed)
           for r in line_dedup.classes(docs_of(docs), block=block).collect()}
    assert got == brute(docs, 2, 40)


def test_strip_lines_and_edge_rows(docs_of):
    passage = "this passage of many words stands in several documents and is kept only once in all of them"
    huge = "\n".join(f"line number {i} of one long text " + "v" * (i % 13) + str(i * i * 7919) * 4 for i in range(3000))
    docs = docs_of([(2, "own start of two, long enough to stay\n" + passage), (1, passage + "\nshort"), (3, passage), (4, None), (5, ""),
                    (6, "a\na\na"), (7, huge), (8, "same\n" + "r" * 60), (8, "same\n" + "r" * 60), (None, passage + "!\nx"), (9, passage + "\nunder a fifth")])
    out = line_dedup.strip_lines(docs)
    assert out.columns == docs.columns
    rows = {}
    for r in out.collect():
        rows.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars is None or r.n_chars == len(r.text)
    assert rows.pop(7) == [huge]
    assert rows == {2: ["own start of two, long enough to stay"], 1: [passage + "\nshort"], 4: [None], 5: [""], 6: ["a\na\na"],
                    8: ["same\n" + "r" * 60] * 2}
    assert line_dedup.strip_lines(docs.where("false")).count() == 0
    assert line_dedup.query(docs.where("false")).count() == 0


def test_short_lines_have_rows_and_classes_of_equal_ones(docs_of):
    long = "a line of well over forty characters, with one edit in another document"
    docs = [(1, f"Home\n\n{long}\nPage 1\n \t"), (2, f"Home\n{long}!\nPage 2\n目录"), (3, "x\nHome\nHome"), (None, "目录"), (4, None)]
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.removed)
           for r in line_dedup.query(docs_of(docs)).collect()}
    assert got == {(1, 0): (1, 0, 0, False), (1, 2): (1, 2, 1, False), (1, 3): (1, 3, 0, False),
                   (2, 0): (1, 0, 0, True), (2, 1): (1, 2, 1, True), (2, 2): (2, 2, 0, False), (2, 3): (2, 3, 0, False),
                   (3, 0): (3, 0, 0, False), (3, 1): (1, 0, 0, True), (3, 2): (1, 0, 0, True), (None, 0): (2, 3, 0, True)}


def test_a_long_remainder_stays_whatever_its_share(docs_of):
    shared = "\n".join(f"shared passage that stands in both documents {(i + 1) * 123456791} " + chr(97 + i % 26) * 9 + chr(97 + i // 26) * 30 for i in range(60))
    own = " ".join(f"own{i}" for i in range(50))
    docs = docs_of([(1, shared), (2, shared + "\n" + own), (3, shared + "\n" + own[:-6])])
    got = {r.doc_id: r.text for r in line_dedup.strip_lines(docs).collect()}
    assert got == {1: got[1], 2: own}
