"""Boolean keyword search on bitmaps equals a filter of sets."""

import random

from pyspark.sql import functions as F

from bibliospark.operators import keyword_index as KX


def brute(rows, queries):
    sets = {}
    for i, kw in rows:
        if i is not None:
            sets.setdefault(i, set()).update(t.strip().lower() for t in (kw or "").split(";") if t.strip())
    out = set()
    for qid in {q[0] for q in queries}:
        mine = [q for q in queries if q[0] == qid]
        clauses = {(c, n): {(k or "").strip().lower() for _, c2, n2, k in mine if (c2, n2) == (c, n)} for _, c, n, _ in mine}
        out |= {(qid, i) for i, s in sets.items() if all(bool(s & k) != n for (_, n), k in clauses.items())}
    return out


def frames(spark, rows, queries):
    return (spark.createDataFrame(rows, "id long, mots_cles string"),
            spark.createDataFrame(queries, "qid long, clause int, negated boolean, keyword string"))


def test_random_queries_equal_sets(spark):
    rnd = random.Random(3)
    words = [f"k{i}" for i in range(12)] + ["Été", "two words"]
    ids = [0, 1, -1, 32_767, 32_768, 32_769, 65_536, 65_537, -32_768, -32_769, 10**12] + rnd.sample(range(100_000), 150)
    rows = [(i, ";".join(rnd.choice(["", " "]) + w.upper() for w in rnd.sample(words, rnd.randrange(0, 6)))) for i in ids]
    rows += [(5, None), (None, "k1"), (ids[12], "k3; K3 ;;k4"), rows[13]]
    queries = [(q, c, rnd.random() < 0.35, rnd.choice(words + [" K1 ", "absent"]))
               for q in range(40) for c in range(rnd.randrange(1, 4)) for _ in range(rnd.randrange(1, 4))]
    queries += [(50, 0, False, ""), (51, 0, False, None), (52, 0, True, None), (53, 0, True, "k1"), (53, 0, False, "k2")]
    articles, asked = frames(spark, rows, queries)
    want = brute(rows, queries)
    for sparse in (KX.SPARSE, 4, 0):  # lists alone, both, bitmaps alone
        index = KX.build_index(articles, sparse=sparse)
        got = [tuple(r) for r in KX.search(index, asked).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert index.sparse().count() == 0 < index.dense().count()


def test_a_frequent_keyword_is_cut_into_buckets(spark):
    articles = spark.range(100_000).select("id", F.when(F.col("id") % 1000 == 0, "all;rare").otherwise("all").alias("mots_cles"))
    index = KX.build_index(articles)
    assert {r.bucket for r in index.dense().where("keyword = 'all'").collect()} == {1, 2, 3, 4}  # id 0 is a list
    asked = frames(spark, [], [(1, 0, False, "all"), (1, 1, True, "rare"), (2, 0, False, "rare"), (2, 1, False, "all")])[1]
    got = {r.qid: r["count"] for r in KX.search(index, asked).groupBy("qid").count().collect()}
    assert got == {1: 99_900, 2: 100}
    plan = index.sparse().where(F.col("keyword").isin(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(keyword, [a,b])" in plan


def test_nothing(spark):
    articles, asked = frames(spark, [(1, "a")], [(1, 0, False, "a"), (2, 0, True, "b")])
    empty = articles.where("false")
    assert KX.search(KX.build_index(empty), asked).count() == 0
    assert KX.search(KX.build_index(articles), asked.where("false")).count() == 0
