"""Reports from deltas equal the reports over all rows after every delta."""

import random

import pytest

from bibliospark.operators import report_store as RS
from bibliospark.operators import reports as R
from bibliospark.session import scratch_path

ARTICLES = "id long, date_publication string, domaine_recherche string"
AUTHORS = [(i, f"Name {i % 7}" if i else None) for i in range(12)]
AFFILIATIONS = [(i, f"L{i}", None if i == 3 else f"C{i % 4}") for i in range(9)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_random_deltas(spark, monkeypatch):
    monkeypatch.setattr(RS, "MERGE", 2)
    rnd = random.Random(2)
    authors = spark.createDataFrame(AUTHORS, "id long, nom_complet string")
    affils = spark.createDataFrame(AFFILIATIONS, "id long, nom_institution string, pays string")
    store = RS.ReportStore.create(spark, scratch_path(spark, "reports"))
    state = {"a": [], "w": [], "f": []}
    new = {"a": lambda: (rnd.randrange(99), rnd.choice([None, "", "2020", "2020-05-01", "n.d."]), rnd.choice([None, "", "  ", "MED", "CS", "AI"])),
           "w": lambda: (rnd.randrange(9), 1 if rnd.random() < 0.4 else rnd.randrange(12)),
           "f": lambda: (rnd.randrange(4), rnd.randrange(9))}
    schemas = {"a": ARTICLES, "w": "article_id long, auteur_id long", "f": "auteur_id long, affiliation_id long"}
    for step in range(3):
        delta = {}
        for t, make in new.items():
            if step == 1 and t == "a":
                continue  # a delta of the bridges alone
            gone = rnd.sample(state[t], len(state[t]) // 2)
            came = [make() for _ in range(40)] if step < 2 else []
            for g in gone:
                state[t].remove(g)
            state[t] += came
            delta[t] = spark.createDataFrame([(*x, 1) for x in came] + [(*x, -1) for x in gone], schemas[t] + ", sign int")
        store.apply(delta.get("a"), delta.get("w"), delta.get("f"))
        a, w, f = (spark.createDataFrame(state[t], schemas[t]) for t in "awf")
        for kind in ("date", "year"):
            assert rows_of(store.publications_by_date(kind)) == rows_of(R.publications_by_date(a, kind))
        assert rows_of(store.top_domains(2)) == rows_of(R.top_domains(a, 2))
        assert rows_of(store.top_authors(authors)) == rows_of(R.top_authors(authors, w))
        assert rows_of(store.top_authors(authors, by="id")) == rows_of(R.top_authors(authors, w, by="id"))
        for once in (False, True):
            assert rows_of(store.top_countries(affils, distinct=once)) == rows_of(R.top_countries(affils, f, distinct=once))
    assert store.last()["base"] == 2  # merged on the way


def test_everything_deleted_and_failed_deltas(spark, monkeypatch):
    store = RS.ReportStore.create(spark, scratch_path(spark, "reports"))
    one = lambda sign: spark.createDataFrame([(1, "2020", "MED", sign)], ARTICLES + ", sign int")
    assert store.top_domains().count() == 0
    store.apply(articles=one(1))
    monkeypatch.setattr(RS.ReportStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.apply(articles=one(1))
    monkeypatch.undo()
    assert rows_of(store.top_domains()) == [("MED", 1)]
    store.apply(articles=one(-1))
    assert store.top_domains().count() == store.publications_by_date().count() == 0
    store.apply(articles=one(-1))  # never inserted
    assert store.top_domains().count() == 0


def test_deltas_are_cut_from_rows_joined_once(spark, tmp_path, monkeypatch):
    import datetime as dt

    from bibliospark.operators import report_store
    from bibliospark.plans import catalog
    day = dt.date(2020, 1, 2)
    tables = {
        "orders": ([(1, day, "5-LOW", "F"), (2, day, "5-LOW", "O"), (3, day, "5-LOW", "P"), (4, day, "5-LOW", "O")],
                   "o_orderkey long, o_orderdate date, o_orderpriority string, o_orderstatus string"),
        "documents": ([(1, "t", "web"), (3, "u", "web")], "doc_id long, text string, source string"),
        "lineitem": ([(1, 7, 5), (1, 8, 5), (2, 7, 5), (3, 7, 6), (4, 8, 6), (9, 7, 5)], "l_orderkey long, l_partkey long, l_suppkey long"),
        "part": ([(7, "Ann", "b"), (8, "Bob", "b")], "p_partkey long, p_name string, p_brand string"),
        "supplier": ([(5, "s5", 0), (6, "s6", 1)], "s_suppkey long, s_name string, s_nationkey long"),
        "nation": ([(0, "FR"), (1, "MA")], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plans, apply = [], report_store.ReportStore.apply

    def watched(self, **parts):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString() for df in parts.values())
        apply(self, **parts)

    monkeypatch.setattr(report_store.ReportStore, "apply", watched)
    got = {tuple(r) for r in catalog.queries()["reports_by_deltas"](spark, str(tmp_path)).collect()}
    assert len(plans) == 12 and not any("Join" in p for p in plans)
    # open orders behind the first half of the keys stay deleted: 1, 2 and 3 are kept
    assert {("author", "Ann", 3), ("author", "Bob", 1), ("country", "FR", 3), ("country", "MA", 1),
            ("country, pairs once", "FR", 2), ("country, pairs once", "MA", 1), ("domain", "web", 2),
            ("date", "2020-01-02", 3), ("year", "2020", 3)} == got
