"""Search through the pivot index equals the exact search, with less work; batches hold one broadcast."""

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast

from bibliospark.operators import pivot_index as PX
from bibliospark.operators import retrieval as RT
from bibliospark.plans.q_retrieval import star
from testdata_paths import SF01


def frames(spark, corpus, queries):
    return (spark.createDataFrame(corpus, "article_id long, embedding array<float>"),
            spark.createDataFrame(queries, "qid long, embedding array<float>"))


def hits(df):
    return sorted((r.qid, r.rank, r.article_id, round(r.distance, 9)) for r in df.collect())


def planted(rng, groups=12, size=60, dim=8):
    centres = rng.normal(size=(groups, dim)) * 10
    out = []
    for g in range(groups):
        # the first group holds a third of all rows
        for _ in range(size * groups // 2 if g == 0 else size):
            out.append((len(out), (centres[g] + rng.normal(size=dim)).astype("float32").tolist()))
    return out


def test_planted_groups_are_left_out_unseen(spark):
    rng = np.random.default_rng(5)
    corpus = planted(rng)
    corpus += [(5000, corpus[3][1]), (5001, corpus[3][1]), (5002, None)]  # copies and a row without a vector
    queries = [(q, corpus[int(i)][1]) for q, i in enumerate(rng.integers(0, len(corpus) - 3, 40))]
    queries += [(100, (rng.normal(size=8) * 10).astype("float32").tolist()), (101, corpus[3][1]), (102, None)]
    c, q = frames(spark, corpus, queries)
    index = PX.build_index(c)
    want = hits(RT.exact_knn(c, q, 7))
    found, work = PX.pivot_knn(index, q, 7)
    assert hits(found) == want
    done = work.collect()
    assert {r.qid for r in done} == set(range(40)) | {100, 101} and {r.total for r in done} == {len(corpus) - 1}
    share = sum(r.compared for r in done) / sum(r.total for r in done)
    assert 7 / len(corpus) <= share < 0.5, share
    # whatever the pivots and batches
    for pivots, batch in ((1, 32 << 20), (3, 2000)):
        assert hits(PX.pivot_knn(PX.build_index(c, pivots), q, 7, batch_bytes=batch)[0]) == want


def test_only_visited_cells_are_read(spark):
    corpus = planted(np.random.default_rng(6))
    c, q = frames(spark, corpus, [(1, corpus[-1][1])])
    index = PX.build_index(c)
    plan = PX._cells(spark, index.path).where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    _, work = PX.pivot_knn(index, q, 3)
    assert work.first().compared < len(corpus) / 3


def test_more_than_there_is_and_nothing(spark):
    c, q = frames(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None)], [(1, [0.0, 0.0]), (2, None)])
    assert hits(PX.pivot_knn(PX.build_index(c), q, 50)[0]) == [(1, 1, 1, 1.0), (1, 2, 2, 2.0)]
    for corpus, asked in ((c.where("false"), q), (c, q.where("false")), (c.where("article_id = 3"), q)):
        found, work = PX.pivot_knn(PX.build_index(corpus), asked, 5)
        assert found.columns == ["qid", "rank", "article_id", "distance"]
        assert found.count() == 0 and work.count() == 0


def test_test_vectors_equal_the_exact_search(spark):
    c, q = star.embedding_corpus(spark, SF01), star.query_vectors(spark, SF01)
    found, work = PX.pivot_knn(PX.build_index(c), q, 5)
    assert hits(found) == hits(RT.exact_knn(c, q, 5))
    done = work.collect()
    # random directions in 64 dimensions: little can be left out
    assert sum(r.compared for r in done) <= sum(r.total for r in done)


@pytest.mark.parametrize("search", ["batches", "pivots"])
def test_one_batch_of_questions_at_a_time(spark, monkeypatch, search):
    rng = np.random.default_rng(9)
    corpus = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(200)]
    c, q = frames(spark, corpus, corpus[:90])
    want = hits(RT.exact_knn(c, q, 4))
    live, most = set(), []
    make, gone = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        b = make(self, value)
        live.add(id(b))
        most.append(len(live))
        return b

    def destroy(self, blocking=False):
        live.discard(id(self))
        gone(self, blocking)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    if search == "batches":
        found = RT.exact_knn(c, q, 4, strategy="batches", broadcast_bytes=90 * 8 * 8 // 6)
    else:
        found, _ = PX.pivot_knn(PX.build_index(c), q, 4, batch_bytes=90 * (64 + 24 * 15) // 6)
    assert len(most) >= 6 and max(most) == 1 and not live
    assert hits(found) == want
