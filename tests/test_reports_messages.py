"""Reports (bag semantics, blanks, collation) and the message log."""

import datetime as dt
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from bibliospark.functions.sequence import sequence_numbers
from bibliospark.operators import messages as M
from bibliospark.operators import reports as R


def test_top_authors_bag_and_homonyms(spark):
    authors = spark.createDataFrame([(1, "Ann"), (2, "Ann"), (3, "Bob")], "id long, nom_complet string")
    bridge = spark.createDataFrame([(10, 1), (10, 1), (11, 2), (12, 3)], "article_id long, auteur_id long")
    by_name = {r.author: r.total for r in R.top_authors(authors, bridge).collect()}
    assert by_name == {"Ann": 3, "Bob": 1}
    by_id = {r.id: r.total for r in R.top_authors(authors, bridge, by="id").collect()}
    assert by_id == {1: 2, 2: 1, 3: 1}


def test_top_domains_blank_and_collation(spark):
    arts = spark.createDataFrame([("José",), ("jose",), ("JOSE ",), ("",), ("   ",), (None,), ("x",)],
                                 "domaine_recherche string")
    binary = {r.domain: r.total for r in R.top_domains(arts).collect()}
    assert binary == {"José": 1, "jose": 1, "JOSE ": 1, "x": 1}
    coll = {r.domain: r.total for r in R.top_domains(arts, collation=R.PARITY_COLLATION).collect()}
    assert coll == {"JOSE ": 3, "x": 1}


def test_top_countries_bag_vs_distinct(spark):
    aff = spark.createDataFrame([(1, "FR"), (2, ""), (3, "MA")], "id long, pays string")
    bridge = spark.createDataFrame([(7, 1), (7, 1), (8, 2), (9, 3)], "auteur_id long, affiliation_id long")
    assert {r.country: r.total for r in R.top_countries(aff, bridge).collect()} == {"FR": 2, "": 1, "MA": 1}
    assert {r.country: r.total for r in R.top_countries(aff, bridge, distinct=True).collect()} == \
        {"FR": 1, "": 1, "MA": 1}


def test_keyword_bag(spark):
    arts = spark.createDataFrame([("A; b ;;a",), ("",), (None,)], "mots_cles string")
    assert sorted(r.keyword for r in R.keyword_bag(arts).collect()) == ["a", "a", "b"]


def test_sequence_numbers_hot_key_matches_window(spark):
    # one user holds most rows and spans many partitions
    rows = [(i, 0 if i % 4 else i % 7, i * 3 % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, user_id long, t long").repartition(16)
    got = sequence_numbers(df, ["t", "id"], key="user_id", out="pos")
    w = Window.partitionBy("user_id").orderBy("t", "id")
    want = df.withColumn("pos", F.row_number().over(w).cast("long"))
    assert sorted(map(tuple, got.select("id", "pos").collect())) == \
        sorted(map(tuple, want.select("id", "pos").collect()))
    glob = sequence_numbers(df, ["id"], out="n")
    assert sorted(r.n for r in glob.collect()) == list(range(1, 3001))


def _msgs(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 5, "q1", "r1", t), (2, 5, "q2", "r2", t), (3, 5, "CLICK me", "r3", t - dt.timedelta(hours=1)),
            (4, 6, "q4", "r4", t)]
    return spark.createDataFrame(rows, M.MESSAGE_SCHEMA)


def test_history_nth_transcript(spark):
    m = _msgs(spark)
    hist = [(r.pos, r.user) for r in M.user_history(m, user_id=5).collect()]
    assert hist == [(1, "CLICK me"), (2, "q1"), (3, "q2")]
    nth = {r.user_id: r.user for r in M.nth_message(m, 1).collect()}
    assert nth == {5: "q1"}
    blocks = {(r.user_id, r.message_no): r.block for r in M.transcript(m).collect()}
    assert blocks[(5, 1)] == "Message 1\nQuestion: CLICK me\nResponse: r3"
    text = {r.user_id: r.transcript for r in M.transcript_text(M.transcript(m)).collect()}
    assert text[6] == "Message 1\nQuestion: q4\nResponse: r4"


def test_delete_owner_guard_search_append(spark):
    m = _msgs(spark)
    req = spark.createDataFrame([(1, 5), (4, 5)], "id long, user_id long")
    assert sorted(r.id for r in M.delete_messages(m, req).collect()) == [2, 3, 4]
    assert [r.id for r in M.discussion_search(m, "click").collect()] == [3]
    assert M.discussion_search(m, "").count() == 4
    new = spark.createDataFrame([(7, "new q", "new r", 1)], "user_id long, question string, response string, o int")
    out = M.append_messages(m, new, order_cols=["o"])
    row = out.where("id = 5").first()
    assert row.user_id == 7 and row.created_at is not None


def test_primary_affiliation_skips_mentions_without_one(spark):
    from bibliospark.operators.normalize import primary_affiliation
    # author 1: first two mentions carry no affiliation, the third wins over a later one
    m = spark.createDataFrame(
        [(1, None, 1, 0, 0), (1, None, 1, 1, 0), (1, 30, 2, 0, 1), (1, 20, 3, 0, 0),
         (2, None, 1, 0, 0), (3, 40, 5, 0, 0), (3, 10, 5, 0, 1)],
        "auteur_id long, affiliation_id long, seq long, a_pos long, f_pos long")
    got = {r.auteur_id: r.affiliation_principale for r in primary_affiliation(m).collect()}
    assert got == {1: 30, 2: None, 3: 40}


def test_author_list_is_ordered_bag(spark):
    authors = spark.createDataFrame([(1, "Zed"), (2, "Ann")], "id long, nom_complet string")
    bridge = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 1)], "article_id long, auteur_id long")
    aa = spark.createDataFrame([(1, 100), (2, 101)], "auteur_id long, affiliation_id long")
    aff = spark.createDataFrame([(100, "Uni", ""), (101, "", "FR")], "id long, nom_institution string, pays string")
    arts = spark.createDataFrame([(10,), (11,), (12,)], "article_id long")
    got = sorted((r.article_id, r.pos, r.nom_complet, r.institution, r.country)
                 for r in R.author_list(arts, authors, bridge, aa, aff).collect())
    assert got == [
        (10, 1, "Ann", "Institution inconnue", "FR"),
        (10, 2, "Ann", "Institution inconnue", "FR"),  # the repeated bridge row repeats
        (10, 3, "Zed", "Uni", "Pays inconnu"),
        (11, 1, "Zed", "Uni", "Pays inconnu"),
    ]


def test_author_list_is_numbered_before_it_is_expanded(spark):
    # homonyms, a null name, repeated rows of every table; nothing that is sorted holds a row per line of a list
    import random
    rnd = random.Random(4)
    names = ["Ann", "Bob", None, "Cy"]
    authors = spark.createDataFrame([(i, names[i % 4]) for i in range(12)] + [(3, "Dan"), (5, "Bob")], "id long, nom_complet string")
    bridge = spark.createDataFrame([(rnd.randrange(9), rnd.randrange(13)) for _ in range(90)], "article_id long, auteur_id long")
    aa = spark.createDataFrame([(rnd.randrange(10), rnd.randrange(7)) for _ in range(60)], "auteur_id long, affiliation_id long")
    aff = spark.createDataFrame([(i, "Uni" if i % 3 else None, "FR" if i % 2 else "") for i in range(6)] + [(2, "Lab", "MA")],
                                "id long, nom_institution string, pays string")
    arts = spark.createDataFrame([(i,) for i in range(8)] + [(2,), (None,)], "article_id long")
    w = Window.partitionBy("article_id").orderBy("nom_complet", "institution", "country")
    want = R.authors_and_affiliations(arts, authors, bridge, aa, aff).withColumn("pos", F.row_number().over(w).cast("long"))
    want = sorted(map(repr, want.collect()))
    for list_rows in (100_000, 0):
        got = R.author_list(arts, authors, bridge, aa, aff, list_rows=list_rows)
        assert sorted(map(repr, got.select(*["article_id", "nom_complet", "institution", "country", "pos"]).collect())) == want
    plan = R.author_list(arts, authors, bridge, aa, aff)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange")


def test_articles_by_year_and_author(spark):
    arts = spark.createDataFrame(
        [(1, "1997-02-01"), (2, "1999-01-01"), (3, "n.d."), (4, "0000-01-01"), (5, "1998"), (6, None)],
        "article_id long, date_publication string")
    authors = spark.createDataFrame([(1, "Fred"), (2, None), (3, "Bob")], "id long, nom_complet string")
    bridge = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (5, 3), (6, 1), (6, 2)],
                                   "article_id long, auteur_id long")
    ids = lambda df: sorted(r.article_id for r in df.collect())
    # 2 is outside the range; 3 only has a NULL name (a non-match); 5 has no match
    assert ids(R.articles_by_year_and_author(arts, authors, bridge, 1997, 1998, "RED")) == [1, 4, 6]
    assert ids(R.articles_by_year_and_author(arts, authors, bridge, 1997, 1998, "")) == [1, 3, 4, 5, 6]
    assert ids(R.articles_by_year_and_author(arts, authors, bridge, None, None, "bob")) == [5]


def test_author_lists_broadcast_nothing_that_grows(spark):
    # well compressed tables have small files and many rows: file sizes must not decide
    arts = spark.range(1, 40).withColumnRenamed("id", "article_id")
    authors = spark.range(1, 9).selectExpr("id", "concat('Author ', id % 5) AS nom_complet")
    bridge = spark.range(120).selectExpr("id % 39 + 1 AS article_id", "id % 8 + 1 AS auteur_id")
    places = spark.range(60).selectExpr("id % 8 + 1 AS auteur_id", "id % 3 + 1 AS affiliation_id")
    aff = spark.range(1, 4).selectExpr("id", "concat('I', id) AS nom_institution", "'P' AS pays")
    out = R.author_list(arts, authors, bridge, places, aff)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    per = Counter(r.article_id for r in rows)
    assert sorted((r.article_id, r.pos) for r in rows) == sorted((a, k) for a, n in per.items() for k in range(1, n + 1))


def test_numbering_broadcasts_no_long_keys(spark, monkeypatch):
    from bibliospark.functions import sequence
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 7 > 0 THEN repeat(string(id % 7), 50) END AS k").repartition(5)
    want = sorted((r.k or "", r.id, r.seq) for r in sequence.sequence_numbers(df, ["id"], key="k").collect())
    monkeypatch.setattr(sequence, "BROADCAST_KEYS", 100)
    out = sequence.sequence_numbers(df, ["id"], key="k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.k or "", r.id, r.seq) for r in out.collect()) == want
