"""Landings judged against persisted keys equal the scan over all records."""

import random

import pytest

from bibliospark.operators import seen_keys as SK
from bibliospark.operators.dedup import greedy_dedup
from bibliospark.session import scratch_path

SCHEMA = "seq long, id string, title string, text string"


def scan(rows):
    ids, titles, kept = set(), set(), []
    for seq, i, t, *_ in sorted(rows):
        if (i, t) != ("", "") and i not in ids and t not in titles:
            ids.add(i)
            titles.add(t)
            kept.append(seq)
    return kept


def harvest(n, seed, keys):
    rnd = random.Random(seed)
    # a third of all ids is blank
    return [(k, rnd.choice(["", f"i{rnd.randrange(keys)}", f"i{rnd.randrange(keys)}"]), rnd.choice(["", f"t{rnd.randrange(keys)}"]),
             f"text {k}") for k in range(n)]


def land_all(spark, store, rows, cuts):
    got = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        out = store.land(spark.createDataFrame(rows[a:b], SCHEMA))
        assert out.columns == ["seq", "id", "title", "text"]
        got += [r.seq for r in out.collect()]
    return sorted(got)


def test_landings_equal_the_scan(spark):
    rows = harvest(500, 3, 200)
    store = SK.SeenKeys.create(spark, scratch_path(spark, "seen"))
    assert land_all(spark, store, rows, (150, 150, 420)) == scan(rows)  # one landing is empty
    assert store.last()["kept"] == len(scan(rows)) == store.keys("k1").distinct().count() == store.keys("k2").count()
    # landing everything again keeps nothing
    assert store.land(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_filters_decide_the_work_only(spark, monkeypatch):
    rows = harvest(400, 5, 5000)
    store = SK.SeenKeys.create(spark, scratch_path(spark, "seen"), blocks=1)
    monkeypatch.setattr(SK, "BITS_PER_KEY", 400)  # outgrown by the second landing
    assert land_all(spark, store, rows, (60, 200)) == scan(rows)
    last = store.last()
    assert last["blocks"] > 1 and last["base"] > 0
    # every kept key passes its filter, of others hardly any
    kept = store.keys("k2").select("key")
    assert store.candidates(kept, "k2").count() == kept.count()
    others = spark.range(4000).selectExpr("sha2(concat('other', id), 256) AS key")
    assert store.candidates(others, "k2").count() < 80
    assert store.seen(others, "k2").count() == 0


def test_a_failed_landing_is_not_seen(spark, monkeypatch):
    rows = harvest(120, 8, 60)
    store = SK.SeenKeys.create(spark, scratch_path(spark, "seen"))
    first = [r.seq for r in store.land(spark.createDataFrame(rows[:50], SCHEMA)).collect()]
    monkeypatch.setattr(SK.SeenKeys, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.land(spark.createDataFrame(rows[50:90], SCHEMA))
    monkeypatch.undo()
    second = [r.seq for r in store.land(spark.createDataFrame(rows[50:], SCHEMA)).collect()]
    assert sorted(first + second) == scan(rows)
    with pytest.raises(Exception, match="already exists"):
        SK.SeenKeys.create(spark, store.path)


def test_input_is_computed_once(spark):
    rows = harvest(200, 9, 40)
    evaluated = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            evaluated.add(len(b))
            yield b

    df = spark.createDataFrame(rows, SCHEMA).repartition(3).mapInPandas(count, SCHEMA)
    assert sorted(r.seq for r in greedy_dedup(df).collect()) == scan(rows)
    assert evaluated.value == len(rows)
