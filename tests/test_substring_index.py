"""Indexed substring search equals the scan, for long and short needles."""

import random

from pyspark.sql import functions as F

from bibliospark.operators import messages as M
from bibliospark.operators import substring_index as SX

TEXTS = [None, "", "a", "ab", "É", "Straße in Köln", "ÉÈ été", "a\0b", "aaa", "AAAA", "x" * 5000 + "Needle" + "y" * 5000,
         "日本語の文章", "𝔘𝔫𝔦 code", "İstanbul"]


def frames(spark, texts, needles):
    t = spark.createDataFrame([(i * 70_000, x, "gram") for i, x in enumerate(texts)], "id long, question string, gram string")
    return t, spark.createDataFrame(list(enumerate(needles)), "nid long, needle string")


def test_random_needles_equal_the_scan(spark):
    rnd = random.Random(4)
    texts = TEXTS + ["".join(rnd.choices("abcAÉ ", k=rnd.randrange(1, 40))) for _ in range(150)]
    needles = [None, "", "a", "É", "é", "ab", "aaa", "AAA", "needle", "xn", "本語", "語の文", "𝔫", "uni", "𝔘𝔫𝔦", "\0", "b\0",
               "not there at all", "ß", "SS", "İ", "in k", " "]
    needles += [rnd.choice("abcé ") + "".join(rnd.choices("abcAÉ ", k=rnd.randrange(0, 6))) for _ in range(25)]
    t, n = frames(spark, texts, needles)
    got = {}
    out = SX.indexed_search(SX.build_index(t), t, n)
    assert out.columns == ["nid", "id", "question", "gram"]
    for r in out.collect():
        got.setdefault(r.nid, []).append(r.id)
    t = t.cache()
    for nid, needle in enumerate(needles):
        want = sorted(r.id for r in M.discussion_search(t, needle).select("id").collect())
        assert sorted(got.get(nid, [])) == want, needle


def test_reads_few_lists_and_verifies_few_texts(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=12)) for _ in range(800)]
    t, n = frames(spark, texts, [words[0], words[1] + " "])
    index = SX.build_index(t)
    found = SX.candidates(index, n).groupBy("nid").count().collect()
    held = [sum(w in x for x in texts) for w in (words[0], words[1] + " ")]
    assert all(h <= r["count"] <= h + 8 for r, h in zip(sorted(found), held))
    plan = index.postings().where(F.col("gram").isin(["abc", "bcd"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [abc,bcd])" in plan
    # lists are cut into blocks of ids
    assert index.postings().groupBy("gram", "block").count().where("count > 1").count() == 0
    assert index.postings().where("gram = 'a'").count() == 0


def test_nothing(spark):
    t, n = frames(spark, TEXTS, ["abc", "a", ""])
    empty = t.where("false")
    assert SX.indexed_search(SX.build_index(empty), empty, n).count() == 0
    assert SX.indexed_search(SX.build_index(t), t, n.where("false")).count() == 0
