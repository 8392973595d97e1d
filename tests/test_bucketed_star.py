"""The bucketed star: joins without an exchange, hot keys apart, results of the plain joins."""

import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from bibliospark.operators import reports as R
from bibliospark.operators.bucketed_star import BucketedStar
from bibliospark.sources import star
from testdata_paths import SF001


def store_of(spark, dims, bridges, buckets=8):
    return BucketedStar(spark, tempfile.mkdtemp(prefix="bucketed-"), buckets, f"t_{uuid.uuid4().hex}").write(dims, bridges)


@pytest.fixture(scope="module")
def store(spark):
    return store_of(spark, {"auteurs": star.authors(spark, SF001), "affiliations": star.affiliations(spark, SF001)},
                    {"article_auteur": star.article_author(spark, SF001),
                     "auteur_affiliation": star.author_affiliation(spark, SF001)})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def bag(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("bridge", ["article_auteur", "auteur_affiliation"])
def test_the_join_has_no_exchange(store, bridge):
    plan = plan_of(store.cold(bridge))
    assert "SortMergeJoin" in plan
    assert "Exchange" not in plan


def test_counting_has_no_exchange_below_its_join(store):
    plan = plan_of(store.cold("article_auteur").groupBy("auteur_id").count())
    assert "Exchange" not in plan


def test_equal_to_the_plain_joins(spark, store):
    plain = R.authors_of_articles(star.authors(spark, SF001), star.article_author(spark, SF001))
    assert bag(store.joined("article_auteur").select("article_id", "nom_complet")) == bag(plain)
    counts = {r.pays: r.n for r in store.mentions("auteur_affiliation", "pays").collect()}
    top = R.top_countries(star.affiliations(spark, SF001), star.author_affiliation(spark, SF001)).collect()
    assert [counts[r.country] for r in top] == [r.total for r in top]


def planted(spark):
    # author 0 holds a third of all rows; author 7 has no dimension row; a null key joins nothing
    rows = [(k, 0) for k in range(300)] + [(k, 1 + k % 40) for k in range(600)] + [(5, None), (6, 77)]
    bridge = spark.createDataFrame(rows, "article_id long, auteur_id long")
    authors = spark.createDataFrame([(k, f"n{k % 9}", "extra") for k in range(40) if k != 7],
                                    "id long, nom_complet string, note string")
    return authors, bridge


def test_a_hot_key_lies_apart(spark):
    authors, bridge = planted(spark)
    s = store_of(spark, {"auteurs": authors}, {"article_auteur": bridge})
    assert {r.auteur_id for r in s.hot("article_auteur").select("auteur_id").collect()} == {0}
    assert s.table("article_auteur").where("auteur_id = 0").isEmpty()
    want = bridge.join(authors.withColumnRenamed("id", "auteur_id"), "auteur_id")
    cols = ["article_id", "auteur_id", "nom_complet", "note"]
    assert bag(s.joined("article_auteur").select(cols)) == bag(want.select(cols))
    counts = want.groupBy("nom_complet").agg(F.count(F.lit(1)).alias("n"))
    assert bag(s.mentions("article_auteur", "nom_complet")) == bag(counts)


def test_another_session_attaches_the_store(spark):
    authors, bridge = planted(spark)
    s = store_of(spark, {"auteurs": authors, "affiliations": spark.createDataFrame([(1, "x")], "id long, pays string")},
                 {"article_auteur": bridge,
                  "auteur_affiliation": spark.createDataFrame([(1, 1)], "auteur_id long, affiliation_id long")})
    again = BucketedStar(spark, s.path, s.buckets, s.prefix + "_again").attach()
    assert "Exchange" not in plan_of(again.cold("article_auteur"))
    assert bag(again.joined("article_auteur")) == bag(s.joined("article_auteur"))


def test_empty_bridge(spark):
    authors, bridge = planted(spark)
    s = store_of(spark, {"auteurs": authors}, {"article_auteur": bridge.limit(0)})
    assert s.joined("article_auteur").isEmpty()
    assert s.mentions("article_auteur", "nom_complet").isEmpty()
