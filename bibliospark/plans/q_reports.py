"""Report queries (A1-A5, J2-J5) over the star."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import star
from .catalog import register
from .oracle import sql_strip, sql_year_of, with_views


@register("top_authors", """
WITH mentions AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY l_partkey),
named AS (SELECT p_name AS author, n FROM part, mentions WHERE part.p_partkey = mentions.part)
SELECT author, CAST(sum(n) AS BIGINT) AS total FROM named GROUP BY author
QUALIFY row_number() OVER (ORDER BY sum(n) DESC, author NULLS FIRST) <= 10""")
def top_authors(spark, base):
    return R.top_authors(star.authors(spark, base), star.article_author(spark, base))


@register("top_authors_by_id", """
WITH mentions AS (SELECT l_partkey AS id, count(*) AS total FROM lineitem GROUP BY l_partkey)
SELECT id, (SELECT p_name FROM part WHERE p_partkey = id) AS author, total FROM mentions
WHERE id IN (SELECT p_partkey FROM part)
QUALIFY row_number() OVER (ORDER BY total DESC, author NULLS FIRST, id) <= 10""")
def top_authors_by_id(spark, base):
    return R.top_authors(star.authors(spark, base), star.article_author(spark, base), by="id")


# Collated reports run over spellings that differ in case, accents and trailing
# blanks, planted by key in the query and in the oracle alike.
def _spelled(name, key):
    k = F.pmod(key, F.lit(4))
    return (F.when(k == 0, F.upper(name)).when(k == 1, F.replace(name, F.lit("e"), F.lit("é")))
            .when(k == 2, F.concat(name, F.lit("  "))).otherwise(name))


def _spelled_sql(name: str, key: str) -> str:
    return (f"CASE {key} % 4 WHEN 0 THEN upper({name}) WHEN 1 THEN replace({name}, 'e', 'é') "
            f"WHEN 2 THEN {name} || '  ' ELSE {name} END")


def _folded_sql(label: str, rows: str, weight: str) -> str:
    return f"""
WITH spelled AS ({rows}),
folded AS (SELECT min(spelling) AS {label}, CAST(sum({weight}) AS BIGINT) AS total FROM spelled
           GROUP BY strip_accents(lower(rtrim(spelling))))
SELECT {label}, total FROM folded QUALIFY row_number() OVER (ORDER BY total DESC, {label} NULLS FIRST) <= 10"""


@register("top_authors_collated", _folded_sql("author", f"""
  SELECT {_spelled_sql('p_name', 'p_partkey')} AS spelling, m.n
  FROM part, (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) m WHERE m.l_partkey = p_partkey""", "n"))
def top_authors_collated(spark, base):
    authors = star.authors(spark, base)
    authors = authors.withColumn("nom_complet", _spelled(F.col("nom_complet"), F.col("id")))
    return R.top_authors(authors, star.article_author(spark, base), collation=R.PARITY_COLLATION)


@register("top_domains_collated", _folded_sql("domain", f"""
  SELECT {_spelled_sql('source', 'doc_id')} AS spelling, 1 AS n
  FROM documents WHERE length(rtrim(source)) > 0 AND doc_id IN (SELECT o_orderkey FROM orders)""", "n"))
def top_domains_collated(spark, base):
    arts = star.articles(spark, base)
    return R.top_domains(arts.withColumn("domaine_recherche", _spelled(F.col("domaine_recherche"), F.col("id"))),
                         collation=R.PARITY_COLLATION)


@register("top_countries_collated", _folded_sql("country", f"""
  SELECT {_spelled_sql('(SELECT n_name FROM nation WHERE n_nationkey = s_nationkey)', 's_suppkey')} AS spelling, m.n
  FROM supplier, (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) m WHERE m.l_suppkey = s_suppkey""", "n"))
def top_countries_collated(spark, base):
    affiliations = star.affiliations(spark, base)
    return R.top_countries(affiliations.withColumn("pays", _spelled(F.col("pays"), F.col("id"))),
                           star.author_affiliation(spark, base), collation=R.PARITY_COLLATION)


@register("top_domains", """
WITH published AS (SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT o_orderkey FROM orders)),
filled AS (SELECT source FROM published WHERE length(rtrim(source)) > 0)
SELECT source AS domain, count(*) AS total FROM filled GROUP BY source
QUALIFY row_number() OVER (ORDER BY count(*) DESC, source) <= 10""")
def top_domains(spark, base):
    return R.top_domains(star.articles(spark, base))


@register("top_countries", """
WITH supplied AS (SELECT l_suppkey AS supp, count(*) AS n FROM lineitem GROUP BY l_suppkey),
placed AS (
  SELECT (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS country, n
  FROM supplier, supplied WHERE supplier.s_suppkey = supplied.supp)
SELECT country, CAST(sum(n) AS BIGINT) AS total FROM placed GROUP BY country
QUALIFY row_number() OVER (ORDER BY sum(n) DESC, country NULLS FIRST) <= 10""")
def top_countries(spark, base):
    return R.top_countries(star.affiliations(spark, base), star.author_affiliation(spark, base))


@register("top_countries_distinct", """
WITH supplied AS (SELECT l_suppkey AS supp, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey),
placed AS (
  SELECT (SELECT n_name FROM nation WHERE n_nationkey = s_nationkey) AS country, n
  FROM supplier, supplied WHERE supplier.s_suppkey = supplied.supp)
SELECT country, CAST(sum(n) AS BIGINT) AS total FROM placed GROUP BY country
QUALIFY row_number() OVER (ORDER BY sum(n) DESC, country NULLS FIRST) <= 10""")
def top_countries_distinct(spark, base):
    return R.top_countries(star.affiliations(spark, base), star.author_affiliation(spark, base),
                           distinct=True)


@register("pubs_by_date", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS year, count(o_orderkey) AS total FROM orders GROUP BY o_orderdate""")
def pubs_by_date(spark, base):
    return R.publications_by_date(star.articles(spark, base))


@register("pubs_by_year", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(o_orderkey) AS total FROM orders GROUP BY ALL""")
def pubs_by_year(spark, base):
    return R.publications_by_date(star.articles(spark, base), granularity="year")


# The reports kept up to date by deltas: the star arrives in two halves, then the
# open articles and their bridge rows go, and one half of these comes back.
_KEPT = "(o_orderstatus <> 'O' OR o_orderkey * 2 <= (SELECT max(o_orderkey) FROM orders))"


@register("reports_by_deltas", f"""
WITH kept AS (SELECT * FROM orders WHERE {_KEPT}),
rows AS (SELECT lineitem.* FROM lineitem JOIN kept ON o_orderkey = l_orderkey),
country AS (SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey),
reports AS (
  SELECT 'date' AS report, strftime(o_orderdate, '%Y-%m-%d') AS label, count(*) AS total FROM kept GROUP BY ALL
  UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM kept GROUP BY ALL
  UNION ALL SELECT 'domain', source, count(*) FROM kept JOIN documents ON doc_id = o_orderkey
            WHERE length(rtrim(source)) > 0 GROUP BY ALL
  UNION ALL SELECT 'author', p_name, count(*) FROM rows JOIN part ON p_partkey = l_partkey GROUP BY ALL
  UNION ALL SELECT 'country', n_name, count(*) FROM rows JOIN country ON s_suppkey = l_suppkey GROUP BY ALL
  UNION ALL SELECT 'country, pairs once', n_name, count(DISTINCT (l_partkey, l_suppkey))
            FROM rows JOIN country ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT report, label, total FROM reports
QUALIFY report IN ('date', 'year') OR row_number() OVER (PARTITION BY report ORDER BY total DESC, label NULLS FIRST) <= 10""")
def reports_by_deltas(spark, base):
    # A1-A4 without a recount: signed deltas of articles and bridges are merged
    from functools import reduce

    from ..operators.report_store import ReportStore
    from ..session import scratch_path, written
    from ..sources.tables import Catalog
    cat = Catalog(spark, base)
    orders = cat.orders.select("o_orderkey", "o_orderstatus")
    half = (orders.agg(F.max("o_orderkey")).first()[0] or 0) // 2  # a scalar
    # the deltas are cut from the joined rows, which are made once
    arts = written(star.articles(spark, base).select("id", "date_publication", "domaine_recherche").join(
        orders, F.col("id") == F.col("o_orderkey")), "report-articles")
    lines = cat.lineitem.select("l_orderkey", F.col("l_partkey").alias("auteur_id"), F.col("l_suppkey").alias("affiliation_id"))
    lines = written(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey"), "report-lines")
    first, open_ = F.col("o_orderkey") <= half, F.col("o_orderstatus") == "O"
    store = ReportStore.create(spark, scratch_path(spark, "report-store"))
    for part, sign in ((first, 1), (~first, 1), (open_, -1), (open_ & first, 1)):
        rows = lines.where(part).withColumn("sign", F.lit(sign))
        store.apply(articles=arts.where(part).withColumn("sign", F.lit(sign)), article_author=rows, author_affiliation=rows)
    affiliations = star.affiliations(spark, base)
    out = [("date", store.publications_by_date()), ("year", store.publications_by_date("year")),
           ("domain", store.top_domains()), ("author", store.top_authors(star.authors(spark, base))),
           ("country", store.top_countries(affiliations)),
           ("country, pairs once", store.top_countries(affiliations, distinct=True))]
    return reduce(lambda x, y: x.unionByName(y), [
        df.select(F.lit(name).alias("report"), F.col(df.columns[0]).cast("string").alias("label"), "total") for name, df in out])


def _keyword_sql(delim: str) -> str:
    tok = f"lower({sql_strip('t')})"
    return with_views(f"""
SELECT keyword, COUNT(*) AS n FROM (
  SELECT {tok} AS keyword
  FROM (SELECT unnest(string_split(mots_cles, '{delim}')) AS t
        FROM articles WHERE mots_cles IS NOT NULL AND rtrim(mots_cles) <> '')
) WHERE keyword <> ''
GROUP BY keyword""", "articles")


@register("keyword_bag", _keyword_sql(";"))
def keyword_bag(spark, base):
    return R.keyword_counts(star.article_keywords(spark, base), ";")


@register("keyword_bag_comma", _keyword_sql(","))
def keyword_bag_comma(spark, base):
    return R.keyword_counts(star.article_keywords(spark, base), ",")


# (clauses that an article must meet, clauses that it must not): alternatives in each
_BOOLEAN = [([["the"], ["and"]], []), ([["re", "er"]], [["en"]]), ([], [["the"], ["en", "in"]]),
            ([["License"], ["this", "are"]], [["absent word"]]), ([["of"], ["no such keyword"]], [])]


def _boolean_sql() -> str:
    def has(words):
        return "list_has_any(tokens, [" + ", ".join(f"'{w.lower()}'" for w in words) + "])"
    return " UNION ALL ".join(
        f"SELECT CAST({q} AS BIGINT) AS qid, id FROM tokened WHERE "
        + " AND ".join([has(c) for c in must] + ["NOT " + has(c) for c in never])
        for q, (must, never) in enumerate(_BOOLEAN))


@register("keyword_boolean", with_views(f"""
WITH tokened AS (
  SELECT id, list_transform(string_split(mots_cles, ' '), lambda t: lower({sql_strip('t')})) AS tokens
  FROM articles WHERE mots_cles IS NOT NULL)
{_boolean_sql()}""", "articles"))
def keyword_boolean(spark, base):
    # A5/U2 as an index: AND, OR and NOT on bitmaps of the articles of each keyword
    from ..operators.keyword_index import build_index, search
    rows = [(q, c, negated, word) for q, (must, never) in enumerate(_BOOLEAN)
            for negated, clauses in ((False, must), (True, never)) for c, words in enumerate(clauses) for word in words]
    queries = spark.createDataFrame(rows, "qid long, clause int, negated boolean, keyword string")
    return search(build_index(star.article_keywords(spark, base), " "), queries)


@register("article_authors", """
SELECT l_orderkey AS article_id, p_name AS nom_complet
FROM lineitem, part WHERE p_partkey = l_partkey""")
def article_authors(spark, base):
    return R.authors_of_articles(star.authors(spark, base), star.article_author(spark, base))


@register("article_authors_point", """
WITH newest AS (SELECT max(o_orderkey) AS k FROM orders)
SELECT k AS article_id, p_name AS nom_complet
FROM newest, lineitem, part WHERE l_orderkey = k AND p_partkey = l_partkey""")
def article_authors_point(spark, base):
    # The point lookup of one article, here the newest order key.
    from ..sources.tables import Catalog
    newest = Catalog(spark, base).orders.agg(F.max("o_orderkey")).first()[0]
    return R.authors_of_articles(star.authors(spark, base), star.article_author(spark, base),
                                 article_id=int(newest))


@register("retrieval_corpus", with_views("""
SELECT id, scopus_id, titre, resume, date_publication, revue, doi, mots_cles, domaine_recherche
FROM articles WHERE resume IS NOT NULL""", "articles"))
def retrieval_corpus(spark, base):
    # S4 + P11 + P22: the 9-column corpus projection of articles with an abstract
    return R.retrieval_corpus(star.articles(spark, base))


@register("article_authors_affils_batch", """
WITH bag AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
places AS (SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey),
described AS (
  SELECT l_partkey, n, CASE WHEN coalesce(s_name, '') = '' THEN 'Institution inconnue' ELSE s_name END AS institution,
         CASE WHEN coalesce(n_name, '') = '' THEN 'Pays inconnu' ELSE n_name END AS country
  FROM bag LEFT JOIN places ON s_suppkey = l_suppkey),
repeated AS (
  SELECT l_orderkey AS article_id, p_name AS nom_complet, institution, country, unnest(range(n)) AS copy
  FROM lineitem JOIN described USING (l_partkey) JOIN part ON p_partkey = l_partkey)
SELECT article_id, nom_complet, institution, country,
       row_number() OVER (PARTITION BY article_id ORDER BY nom_complet, institution, country) AS pos
FROM repeated""")
def article_authors_affils_batch(spark, base):
    # J5 + A9 for every article of the corpus: its author lines as an ordered list
    arts = star.article_dates(spark, base).select(F.col("id").alias("article_id"))
    return R.author_list(arts, star.authors(spark, base), star.article_author(spark, base),
                         star.author_affiliation(spark, base), star.affiliations(spark, base))


# A6/K6 over the line mentions: a line of an order not yet returned ('N') names
# no affiliation yet, so an author's first mentions may carry none.
@register("primary_affiliation", """
WITH m AS (
  SELECT l_partkey AS auteur_id, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS affiliation_id,
         l_orderkey, l_linenumber, l_suppkey
  FROM lineitem),
f AS (
  SELECT auteur_id, affiliation_id,
         row_number() OVER (PARTITION BY auteur_id ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r
  FROM m WHERE affiliation_id IS NOT NULL)
SELECT a.auteur_id, f.affiliation_id AS affiliation_principale
FROM (SELECT DISTINCT auteur_id FROM m) a
LEFT JOIN f ON f.auteur_id = a.auteur_id AND f.r = 1""")
def primary_affiliation(spark, base):
    from ..operators.normalize import primary_affiliation as primary
    from ..sources.tables import Catalog
    li = Catalog(spark, base).lineitem
    mentions = li.select(F.col("l_partkey").alias("auteur_id"),
                         F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("affiliation_id"),
                         "l_orderkey", "l_linenumber", "l_suppkey")
    return primary(mentions, order=("l_orderkey", "l_linenumber", "l_suppkey"))


@register("clean_to_blank", with_views(f"""
SELECT id,
       coalesce({sql_strip('titre')}, '') AS titre,
       coalesce({sql_strip('resume')}, '') AS resume,
       coalesce({sql_strip('date_publication')}, '') AS date_publication,
       coalesce({sql_strip('revue')}, '') AS revue,
       coalesce({sql_strip('doi')}, '') AS doi,
       coalesce({sql_strip('domaine_recherche')}, '') AS domaine_recherche
FROM articles""", "articles"))
def clean_to_blank(spark, base):
    # The loader's (x or "").strip() on every text field of the articles
    from ..functions.text import blank_if_null
    a = star.articles(spark, base)
    fields = ["titre", "resume", "date_publication", "revue", "doi", "domaine_recherche"]
    return a.select("id", *[blank_if_null(c).alias(c) for c in fields])


# P14 + P15 corpus-wide: articles of an inclusive year range (unknown years
# pass) with an author whose name contains the needle (NULL names never match).
FILTER_YEARS = (1997, 1998)
FILTER_NEEDLE = "red"


@register("author_year_filter", with_views(f"""
SELECT a.id AS article_id, a.date_publication
FROM articles a
WHERE (({sql_year_of('a.date_publication')}) IS NULL OR ({sql_year_of('a.date_publication')}) = 0
       OR ({sql_year_of('a.date_publication')}) BETWEEN {FILTER_YEARS[0]} AND {FILTER_YEARS[1]})
  AND EXISTS (SELECT 1 FROM article_author aa JOIN authors au ON au.id = aa.auteur_id
              WHERE aa.article_id = a.id
                AND coalesce(contains(lower(au.nom_complet), lower('{FILTER_NEEDLE}')), false))""",
    "articles", "article_author", "authors"))
def author_year_filter(spark, base):
    from ..operators.retrieval import check_year_bound
    lo = check_year_bound(str(FILTER_YEARS[0]), lo=1900, hi=2100)
    hi = check_year_bound(str(FILTER_YEARS[1]), lo=1900, hi=2100)
    arts = star.article_dates(spark, base).select(F.col("id").alias("article_id"), "date_publication")
    return R.articles_by_year_and_author(arts, star.authors(spark, base), star.article_author(spark, base),
                                         lo, hi, FILTER_NEEDLE)
