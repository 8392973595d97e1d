"""Operator 12 against numpy's eigenvectors and Python integers."""

import math

import numpy as np
import pytest

from bibliospark.llm import whitening
from bibliospark.sources.tables import table

SCHEMA = "vec_id long, embedding array<float>, label int, n long, `v.x` int, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "c") for i, v in rows], SCHEMA)


def check(got, rows):
    """Results against eigh of the exact covariance; rows: (vec_id, entries)."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(dim)]
    y = np.array([[n * a - b for a, b in zip(r, s)] for r in x], object)
    c = (y / n).astype(float)
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    rank = int((e > 1e-12 * e[0]).sum()) if n > 1 and e[0] > 0 else 0
    k = min(32, rank)
    assert len(got) == n * k
    assert {r.n for r in got} == ({n} if k else set())
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
        assert r.identity_error < 1e-9
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
    dev = (y * y).sum(1)
    w = c @ (axes[:, :k] / np.sqrt(e[:k]))
    for (i, _), d, row in zip(rows, dev, w):
        cells = by[(i, int(d))]
        assert sorted(cells) == list(range(1, k + 1))
        for m in range(k):
            gap = min([abs(e[m] - e[o]) for o in (m - 1, m + 1) if 0 <= o < dim], default=1) / e[0]
            if gap > 1e-6:
                assert any(abs(abs(r.whitened) - abs(row[m])) < 1e-7 for r in cells[m + 1])
    return k


def test_whole_table_against_eigh(spark):
    t = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    got = whitening.whiten(t).collect()
    assert check(got, rows) == 32
    w = np.zeros((len(rows), 32))
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
    assert abs(w.T @ w / len(rows) - np.eye(32)).max() < 1e-9  # one sign for all rows


def test_dropped_repeated_and_dependent_rows(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(60, 3))
    good = [(i, [*r, r[0], 0.5]) for i, r in enumerate(base.tolist())]  # a copied and a constant dimension
    good += [good[0], good[0], (None, good[1][1])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [1.0, math.nan, 1.0, 1.0, 1.0]),
           (103, [1.0, 2.0, math.inf, 1.0, 1.0]), (104, []), (105, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, bad + good)).collect()
    assert check(got, good) == 3


def test_nothing_to_whiten(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(frame(spark, rows))
        assert out.columns == names and out.count() == 0


def test_large_entries_keep_exact_sums(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [1e30, -7.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {(r.vec_id, r.deviation) for r in got} == {(1, None), (2, None), (3, None)}  # beyond a long
    n, total = whitening.sums(whitening._usable(frame(spark, rows[:2])), 2)
    assert (n, total) == (2, [2_000_000, 2_000_192])


def test_cholesky_and_jacobi_on_ranks():
    rnd = np.random.default_rng(1)
    for dim, rank in ((1, 1), (5, 5), (17, 9), (64, 64)):
        b = rnd.normal(size=(dim, rank)) * np.logspace(0, -4, rank)
        v = b @ b.T
        low = whitening.pivoted_cholesky(v)
        assert low.shape == (dim, rank) and np.allclose(low @ low.T, v, atol=1e-12)
        values, axes = whitening.one_sided_jacobi(low)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-9, atol=1e-14)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)
        assert np.allclose(v @ axes, axes * values, atol=1e-12)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    values, axes = whitening.one_sided_jacobi(np.eye(4))
    assert np.allclose(values, 1) and np.allclose(abs(axes), np.eye(4))
