"""The bibliographic star recast over the landed test tables.

The engine's operators work on the relational model of the corpus
(articles, authors, affiliations and the two many-to-many bridges, plus the
message log and the embedding table). The landed test data is TPC-H shaped,
so these views map it once, declaratively; the DuckDB oracle uses the same
mapping in SQL (``bibliospark.plans.oracle``).

| entity             | built from                                         |
| ------------------ | -------------------------------------------------- |
| articles           | orders LEFT JOIN documents ON doc_id = o_orderkey  |
| authors            | part                                               |
| article_author     | lineitem (l_orderkey, l_partkey), a bag            |
| affiliations       | supplier JOIN nation                               |
| author_affiliation | lineitem (l_partkey, l_suppkey), a bag             |
| messages           | events                                             |
| vectors            | embeddings LEFT JOIN articles ON vec_id = id       |

Orders without a document have a NULL abstract and domain, which exercises the
``IS NOT NULL`` / non-blank filters on real rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Catalog


def articles(spark: SparkSession, base: str) -> DataFrame:
    cat = Catalog(spark, base)
    return _articles(cat.orders, cat.documents)


def articles_for(spark: SparkSession, base: str, ids: DataFrame, id_col: str = "article_id") -> DataFrame:
    """``articles`` restricted to the ids of ``ids`` (e.g. a batch of hits).

    Orders and documents are first semi-joined to the ids, a small side AQE
    broadcasts, so only the abstracts of those articles leave their scan.
    ``articles`` itself is orders LEFT JOIN documents, where the documents
    side (the texts) is the only side a left join can broadcast, so without
    this the whole text column is shuffled."""
    cat = Catalog(spark, base)
    keys = ids.select(F.col(id_col).alias("_k")).distinct()
    o = cat.orders.join(keys, F.col("o_orderkey") == F.col("_k"), "left_semi")
    d = cat.documents.join(keys, F.col("doc_id") == F.col("_k"), "left_semi")
    return _articles(o, d)


def article_keywords(spark: SparkSession, base: str) -> DataFrame:
    """(id, mots_cles) of the articles that carry a keyword string: the rows
    of ``articles`` whose ``mots_cles`` is not NULL. Built as the documents
    semi-joined to the order keys, so the texts are not shuffled while the
    key column is small enough for AQE to broadcast (a sort-merge semi join
    beyond that, which moves no more than the outer join did)."""
    cat = Catalog(spark, base)
    keys = cat.orders.select("o_orderkey")
    d = cat.documents.select("doc_id", "text").where(F.col("text").isNotNull())
    return d.join(keys, F.col("doc_id") == F.col("o_orderkey"), "left_semi").select(
        F.col("doc_id").alias("id"), F.col("text").alias("mots_cles"))


def _articles(orders: DataFrame, documents: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    d = documents.select("doc_id", "text", "source")
    return (
        o.join(d, o.o_orderkey == d.doc_id, "left")
        .select(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderkey").cast("string").alias("scopus_id"),
            F.concat(F.lit("Article "), F.col("o_orderkey").cast("string")).alias("titre"),
            F.col("text").alias("resume"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_publication"),
            F.col("o_orderpriority").alias("revue"),
            F.when(F.col("o_orderstatus") == "F",
                   F.concat(F.lit("10.5555/"), F.col("o_orderkey").cast("string")))
            .otherwise(F.lit("")).alias("doi"),
            F.col("text").alias("mots_cles"),
            F.col("source").alias("domaine_recherche"),
        )
    )


def authors(spark: SparkSession, base: str) -> DataFrame:
    return Catalog(spark, base).part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_partkey").cast("string").alias("scopus_author_id"),
        F.col("p_name").alias("nom_complet"),
        F.col("p_brand").alias("orcid"),
    )


def article_author(spark: SparkSession, base: str) -> DataFrame:
    return Catalog(spark, base).lineitem.select(
        F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("auteur_id"))


def affiliations(spark: SparkSession, base: str) -> DataFrame:
    cat = Catalog(spark, base)
    s = cat.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = cat.nation.select("n_nationkey", "n_name")
    # nation is a fixed 25-row dimension: broadcasting it is bounded by design.
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("nom_institution"),
        F.col("n_name").alias("pays"),
        F.col("s_suppkey").cast("string").alias("scopus_affiliation_id"),
    )


def author_affiliation(spark: SparkSession, base: str) -> DataFrame:
    return Catalog(spark, base).lineitem.select(
        F.col("l_partkey").alias("auteur_id"), F.col("l_suppkey").alias("affiliation_id"))


def messages(spark: SparkSession, base: str) -> DataFrame:
    return Catalog(spark, base).events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("question"),
        F.col("props").alias("response"),
        F.col("ts").alias("created_at"),
    )


def article_dates(spark: SparkSession, base: str) -> DataFrame:
    """(id, date_publication) of the articles, read from orders alone (the
    document side of ``articles`` is not needed for dates)."""
    return Catalog(spark, base).orders.select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_publication"))


def embedding_corpus(spark: SparkSession, base: str) -> DataFrame:
    """Retrieval vectors without dates: (article_id, embedding), no join."""
    return Catalog(spark, base).embeddings.select(F.col("vec_id").alias("article_id"), "embedding")


def vectors(spark: SparkSession, base: str) -> DataFrame:
    """Retrieval corpus with dates: (article_id, embedding, date_publication)."""
    e = embedding_corpus(spark, base)
    a = article_dates(spark, base)
    return e.join(a, e.article_id == a.id, "left").select("article_id", "embedding", "date_publication")


def query_vectors(spark: SparkSession, base: str) -> DataFrame:
    """A batch of questions as vectors: every embedding asks for its neighbours."""
    return Catalog(spark, base).embeddings.select(F.col("vec_id").alias("qid"), "embedding")
