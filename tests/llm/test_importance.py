import random

import pytest

from bibliospark.llm import importance


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_target_like_documents_are_drawn(spark, docs_of):
    rnd = random.Random(1)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(80))) for i in range(400)]
    # labels on the first half; the second half is held out
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(200)] + [(1, 1, 0), (3, 0, 0)])
    got = {r.doc_id: r for r in importance.resample(docs_of(rows), labels, share=0.5).collect()}
    drawn = [d for d, r in got.items() if r.selected]
    assert len(drawn) == 200
    held = [d for d in got if d >= 200]
    assert sum(got[d].selected == bool(d % 2) for d in held) >= 0.9 * len(held)
    assert all(got[d].log_ratio > got[d + 1].log_ratio for d in range(1, 399, 2))


def test_toxic_rows_are_no_target_and_edge_rows(spark, docs_of):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, " \n"), (5, "solo"), (5, "solo"), (None, "no id"), (6, "w " * 50_000)]
    docs = docs_of(rows)
    out = importance.resample(docs, labels_of(spark, [(1, 1, 0), (5, 1, 1), (None, 1, 0), (77, 1, None)]), share=1.0).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.selected == (r.n_ngrams > 0) and (r.log_ratio is None) == (r.n_ngrams == 0)
    n = {r.doc_id: r.n_ngrams for r in out}
    assert n[1] == 5 and n[5] == 1 and n[2] == 0 and n[6] == 99_999
    assert importance.resample(docs.where("false"), labels_of(spark, [])).count() == 0
    assert not [r for r in importance.resample(docs, labels_of(spark, []), share=0.0).collect() if r.selected]


@pytest.mark.parametrize("seed", [0, 1])
def test_kth_largest_without_sorting(spark, seed, monkeypatch):
    monkeypatch.setattr(importance, "_BINS", 4)
    rnd = random.Random(seed)
    keys = [rnd.choice((rnd.gauss(0, 1), 0.5, 1e300, -1e-300)) for _ in range(300)]
    frame = spark.createDataFrame([(x,) for x in keys] + [(None,)], "key double")
    for k in (1, 2, 57, 299, 300):
        assert importance.kth_largest(frame, k) == sorted(keys)[-k]
    assert importance.kth_largest(frame, 301) is None and importance.kth_largest(frame, 0) is None


def test_gumbel_draws_follow_the_weights(spark, docs_of):
    rows = [(i, "x y z" if i < 1000 else "p q r") for i in range(2000)]
    got = importance.resample(docs_of(rows), labels_of(spark, []), share=0.3).collect()
    drawn = [r.doc_id < 1000 for r in got if r.selected]  # equal weights: both alike
    assert len(drawn) == 600 and abs(sum(drawn) - 300) < 60


def test_target_sample_is_bounded(spark, docs_of, monkeypatch):
    import numpy as np
    monkeypatch.setattr(importance, "TARGETS", 50)
    docs = docs_of([(i, f"t{i} same") for i in range(400)])
    labels = labels_of(spark, [(i, 1, 0) for i in range(400)])
    ratio = importance.models(docs, labels)
    seen = [i for i in range(400) if ratio[importance.ngram_buckets(f"t{i}")[0]] > -0.3]
    assert 20 < len(seen) < 100
    monkeypatch.setattr(importance, "TARGETS", 400)
    assert np.allclose(importance.models(docs, labels), 0)


def test_whole_table_against_counts_in_dictionaries(spark):
    import math
    import zlib
    from collections import Counter

    from pyspark.sql import functions as F

    from bibliospark.llm.queries import op7_importance_resampling
    from bibliospark.sources.tables import table

    base, buckets = "/root/testdata/sf0.001", importance.BUCKETS
    docs = table(spark, base, "documents")
    good = {r.doc_id for r in table(spark, base, "labels").collect() if r.quality == 1 and not r.toxic}
    rows = docs.select("doc_id", "text", F.xxhash64(F.lit("gumbel"), "doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()

    def grams(text):
        words = [zlib.crc32(w) for w in (text or "").encode().lower().split()]
        pairs = [((a * 0x9E3779B1 + b) * 0xC2B2AE3D27D4EB4F % 2**64) >> 32 for a, b in zip(words, words[1:])]
        return [x % buckets for x in words + pairs]

    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r.text))
        if r.doc_id in good:
            target.update(grams(r.text))
    n_raw, n_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    want = {}
    for r in rows:
        g = grams(r.text)
        weight = sum(math.log((target[x] + 1) / n_target) - math.log((raw[x] + 1) / n_raw) for x in g) if g else None
        u = ((r.h % 2**64 >> 12) + 0.5) / 2**52
        want[r.doc_id] = (len(g), weight, None if weight is None else weight - math.log(-math.log(u)))
    keys = sorted((k for _, _, k in want.values() if k is not None), reverse=True)
    drawn = round(len(keys) * importance.SHARE)
    got = op7_importance_resampling(spark, base).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        n, weight, key = want[r.doc_id]
        assert r.n_ngrams == n
        if key is None:
            assert r.log_ratio is None and not r.selected
        else:
            assert r.log_ratio == pytest.approx(weight, rel=1e-9, abs=1e-9) and r.key == pytest.approx(key, rel=1e-9, abs=1e-9)
            assert r.selected == (key >= keys[drawn - 1] - 1e-9)
