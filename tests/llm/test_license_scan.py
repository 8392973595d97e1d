import math
import random
import re

from bibliospark.llm import license_scan


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text):
    w = words_of(text)
    at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w))
          if w[i:i + len(p.split())] == p.split()]
    best, labels = 0.0, {x for _, x in at}
    half = license_scan.BLOCK_WORDS // 2
    for start in range(0, len(w), half):
        block = set(w[start:start + 2 * half])
        for label, body in license_scan.TEMPLATES:
            t = set(body.split())
            if len(block & t) >= math.ceil(0.8 * len(t) - 1e-9):
                labels.add(label)
                best = max(best, len(block & t) / len(t))
    ids = [i for i, _ in at]
    return (len(w), len(at), min(ids, default=None), max(ids, default=None),
            ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), 1.0 if at else best)


def test_blocks_and_phrases_against_brute_force(docs_of):
    rnd = random.Random(6)
    filler = ["the", "of", "and", "this", "software", "license", "is", "in", "or", "alpha", "beta", "4", "under", "cc"]
    docs = []
    for d in range(120):
        parts = [rnd.choice(filler) for _ in range(rnd.randrange(150))]
        if d % 3:
            body = rnd.choice(license_scan.TEMPLATES)[1].split()
            body = [x for x in body if rnd.random() > rnd.choice((0, .1, .2, .3))]
            if rnd.random() < 0.3:
                rnd.shuffle(body)
            k = rnd.randrange(len(parts) + 1)
            parts[k:k] = body
        docs.append((d, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "MIT  License, GNU General-Public\nLICENSE; apache license."),
             (203, "mit license mit license"), (203, "mit license mit license"), (None, "Licensed under CC BY-NC 4.0."),
             (204, "licenses mit licensee general public"), (205, "word " * 30_000 + "mit license"), (206, "license")]
    got = sorted((tuple(r) for r in license_scan.scan(docs_of(docs)).collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    assert sum(bool(brute(t)[5]) for _, t in docs) > 30
    assert license_scan.scan(docs_of([])).count() == 0
