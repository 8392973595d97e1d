"""Aggregate reports over the star.

Scale notes
-----------
* The bridges are the big tables. Every count-by-dimension report first
  aggregates the bridge on its foreign key (partial aggregation runs map-side,
  so a hot key costs one row per task, not one row per mention), then joins
  the much smaller per-key counts to the dimension, then re-aggregates by the
  reported attribute. Same answer as join-then-count, far less shuffle.
* Top-k is ``orderBy(...).limit(k)``, planned as ``TakeOrderedAndProject``:
  each task keeps its local k rows, the driver merges k x tasks rows.
* Ties are broken on the label, so the ten rows are deterministic (the
  reference leaves ties to the database).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_tokens, year_of
from ..session import never_broadcast

# Collation that matches a case- and accent-insensitive, trailing-space
# insensitive database collation.
PARITY_COLLATION = "UNICODE_CI_AI_RTRIM"


def _label(c: Column, collation: str | None) -> Column:
    return F.collate(c, collation) if collation else c


def _top(df: DataFrame, label: str, k: int) -> DataFrame:
    return df.orderBy(F.col("total").desc(), F.col(label).asc_nulls_first()).limit(k)


def _collated_count(counts: DataFrame, key: str, label: str, collation: str | None,
                    weight: str = "n") -> DataFrame:
    """Sum ``weight`` by ``key``; with a collation, equal-under-collation values
    form one group, labelled by their smallest binary spelling."""
    if not collation:
        return counts.groupBy(F.col(key).alias(label)).agg(
            F.sum(weight).cast("long").alias("total"))
    grouped = counts.groupBy(_label(F.col(key), collation).alias("_k")).agg(
        F.min(F.col(key)).alias(label), F.sum(weight).cast("long").alias("total"))
    return grouped.select(label, "total")


def publications_by_date(articles: DataFrame, granularity: str = "date") -> DataFrame:
    """A1 + L2: count per publication date string (the reference's "by year"
    binds to the full date), or per year with ``granularity='year'``."""
    if granularity == "date":
        key = F.col("date_publication")
    elif granularity == "year":
        key = year_of("date_publication")
    else:
        raise ValueError("granularity must be 'date' or 'year'")
    return (articles.groupBy(key.alias("year"))
            .agg(F.count(F.lit(1)).alias("total"))
            .orderBy(F.col("year").asc_nulls_first()))


def top_domains(articles: DataFrame, k: int = 10, collation: str | None = None) -> DataFrame:
    """A2 + P23 + L1: top-k research domains, NULL and blank excluded.

    Blank follows PAD SPACE comparison: a value of spaces only equals ''."""
    d = F.col("domaine_recherche")
    counts = articles.select(d).where(has_domain(d)).groupBy(d).agg(F.count(F.lit(1)).alias("n"))
    return ranked_domains(counts, k, collation)


def has_domain(d: Column) -> Column:
    return d.isNotNull() & (F.rtrim(d) != "")


def ranked_domains(counts: DataFrame, k: int = 10, collation: str | None = None) -> DataFrame:
    """A2 from counts (domaine_recherche, n)."""
    return _top(_collated_count(counts, "domaine_recherche", "domain", collation), "domain", k)


def top_authors(authors: DataFrame, article_author: DataFrame, k: int = 10,
                by: str = "name", collation: str | None = None) -> DataFrame:
    """A3 + J3 + L1: top-k authors by bridge rows. Grouped by name as in the
    reference (homonyms merge); ``by='id'`` keeps them apart."""
    per_author = article_author.groupBy("auteur_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked_authors(per_author, authors, k, by, collation)


def ranked_authors(per_author: DataFrame, authors: DataFrame, k: int = 10, by: str = "name",
                   collation: str | None = None) -> DataFrame:
    """A3 from counts (auteur_id, n)."""
    joined = per_author.join(authors.select("id", "nom_complet"),
                             per_author.auteur_id == F.col("id"))
    if by == "id":
        res = joined.groupBy("id").agg(F.min("nom_complet").alias("author"),
                                       F.sum("n").cast("long").alias("total"))
        return res.orderBy(F.col("total").desc(), F.col("author").asc_nulls_first(),
                           F.col("id")).limit(k)
    return _top(_collated_count(joined, "nom_complet", "author", collation), "author", k)


def top_countries(affiliations: DataFrame, author_affiliation: DataFrame, k: int = 10,
                  distinct: bool = False, collation: str | None = None) -> DataFrame:
    """A4 + J4 + L1: top-k countries by author-affiliation bridge rows
    (mentions), blank country included; ``distinct=True`` counts each
    (author, affiliation) pair once."""
    bridge = author_affiliation.select("auteur_id", "affiliation_id")
    if distinct:
        bridge = bridge.dropDuplicates(["auteur_id", "affiliation_id"])
    per_aff = bridge.groupBy("affiliation_id").agg(F.count(F.lit(1)).alias("n"))
    return ranked_countries(per_aff, affiliations, k, collation)


def ranked_countries(per_aff: DataFrame, affiliations: DataFrame, k: int = 10,
                     collation: str | None = None) -> DataFrame:
    """A4 from counts (affiliation_id, n)."""
    joined = per_aff.join(affiliations.select("id", "pays"),
                          per_aff.affiliation_id == F.col("id"))
    return _top(_collated_count(joined, "pays", "country", collation), "country", k)


def keyword_bag(articles: DataFrame, delimiter: str = ";") -> DataFrame:
    """A5 + U2: every keyword token of every article (a bag, duplicates kept).

    Rows whose keyword string is NULL or '' contribute nothing."""
    kw = F.col("mots_cles")
    return (articles.select(kw).where(kw.isNotNull() & (F.rtrim(kw) != ""))
            .select(F.explode(split_tokens(kw, delimiter)).alias("keyword")))


def keyword_counts(articles: DataFrame, delimiter: str = ";") -> DataFrame:
    """The keyword bag summarised as (keyword, n) with map-side combine."""
    return keyword_bag(articles, delimiter).groupBy("keyword").agg(
        F.count(F.lit(1)).alias("n"))


def authors_of_articles(authors: DataFrame, article_author: DataFrame,
                        article_id: int | None = None) -> DataFrame:
    """J2 (+P16): author names per article (bag); one article with ``article_id``."""
    bridge = article_author
    if article_id is not None:
        bridge = bridge.where(F.col("article_id") == F.lit(article_id))
    return bridge.join(authors.select("id", "nom_complet"),
                       bridge.auteur_id == F.col("id")).select("article_id", "nom_complet")


def authors_and_affiliations(hits: DataFrame, authors: DataFrame, article_author: DataFrame,
                             author_affiliation: DataFrame, affiliations: DataFrame,
                             corpus_wide: bool = False) -> DataFrame:
    """J5 for a whole batch of hits in one set-based join (the reference issues
    one query per hit). Inner to the bridge and author, then LEFT to the
    author-affiliation bridge and affiliation; repeated bridge rows repeat
    output rows. P13 defaults are applied to NULL *or* empty values.

    ``hits`` must carry ``article_id``; its other columns are kept. Where they are
    as many as the corpus has (``corpus_wide``), nothing that grows with it is broadcast.
    """
    side = never_broadcast if corpus_wide else (lambda df: df)
    # repeated bridge rows are carried as a multiplicity through the joins and
    # expanded at the end, so a prolific author's mentions never meet all of his
    # affiliation rows one by one
    a = authors.select(F.col("id").alias("_aid"), "nom_complet")
    aa = (author_affiliation.groupBy(F.col("auteur_id").alias("_aa_auteur"), F.col("affiliation_id").alias("_aa_aff"))
          .agg(F.count(F.lit(1)).alias("_n")))
    af = affiliations.select(F.col("id").alias("_afid"), "nom_institution", "pays")
    bridge = (article_author.groupBy(F.col("article_id").alias("_art"), F.col("auteur_id").alias("_auteur"))
              .agg(F.count(F.lit(1)).alias("_m")))
    out = (side(hits).join(side(bridge), hits.article_id == bridge._art)
           .join(side(a), F.col("_auteur") == F.col("_aid"))
           .join(side(aa), F.col("_aid") == F.col("_aa_auteur"), "left")
           .join(af, F.col("_aa_aff") == F.col("_afid"), "left"))
    copies = F.col("_m") * F.coalesce("_n", F.lit(1))
    keep = [c for c in hits.columns]
    return out.select(
        *keep,
        "nom_complet",
        F.coalesce(F.nullif("nom_institution", F.lit("")), F.lit("Institution inconnue")).alias("institution"),
        F.coalesce(F.nullif("pays", F.lit("")), F.lit("Pays inconnu")).alias("country"),
        F.explode(F.sequence(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


def author_list(articles: DataFrame, authors: DataFrame, article_author: DataFrame,
                author_affiliation: DataFrame, affiliations: DataFrame, list_rows: int = 100_000) -> DataFrame:
    """A9 for every article: the J5 rows of each article (one per author and
    affiliation, duplicates kept) as an ordered list in exploded form,
    ``pos`` = 1.. in (name, institution, country) order.

    The J5 rows are built and numbered once per author, not once per mention: an
    article's list is the lists of its authors one behind the other by name, so
    a row's position is the sizes of the lists before plus its place in its own.
    Authors of one article with one name share a list; these alone are merged,
    one of more than ``list_rows`` rows over many tasks. The rows of all articles appear last and are neither sorted nor moved. All
    numbering is by weight (``sequence_numbers``), which spreads an article or
    author with a huge list over many tasks."""
    from ..functions.sequence import sequence_numbers
    from ..session import written
    ids = authors.select(F.col("id").alias("article_id")).distinct()  # each author as an article of its own
    own = ids.select("article_id", F.col("article_id").alias("auteur_id"))
    line = authors_and_affiliations(ids, authors, own, author_affiliation, affiliations, corpus_wide=True)
    line = (line.groupBy(F.col("article_id").alias("_au"), "nom_complet", "institution", "country")
            .agg(F.count(F.lit(1)).alias("_n")).withColumn("_of", F.struct("_au", "nom_complet")))
    line = written(sequence_numbers(line, ["institution", "country"], key="_of", out="_in", start=0, weight="_n")
                   .select("_au", "nom_complet", "institution", "country", "_n", "_in"), "author-lines")
    sizes = line.groupBy("_au", "nom_complet").agg(F.sum("_n").alias("_size"))

    copies = articles.groupBy("article_id").agg(F.count(F.lit(1)).alias("_c"))
    bridge = (article_author.groupBy(F.col("article_id").alias("_art"), F.col("auteur_id").alias("_auteur"))
              .agg(F.count(F.lit(1)).alias("_m")))
    entries = written(
        never_broadcast(copies).join(never_broadcast(bridge), F.col("article_id") == F.col("_art"))
        .join(never_broadcast(sizes), F.col("_auteur") == F.col("_au"))
        .select("article_id", "nom_complet", "_au", (F.col("_c") * F.col("_m")).alias("_w"), "_size"), "author-entries")
    # the lists of an article, one per name
    lists = entries.groupBy("article_id", "nom_complet").agg(
        F.sum(F.col("_w") * F.col("_size")).alias("_len"), (F.count(F.lit(1)) > 1).alias("_shared"))
    lists = sequence_numbers(lists, ["nom_complet"], key="article_id", out="_first", weight="_len").select(
        F.col("article_id").alias("_a"), F.col("nom_complet").alias("_name"), "_first",
        F.when(~F.col("_shared"), "alone").when(F.col("_len") <= list_rows, "merged").otherwise("spread").alias("_kind"))
    placed = written(never_broadcast(entries).join(never_broadcast(lists), (F.col("article_id") == F.col("_a")) & F.col("nom_complet").eqNullSafe(F.col("_name")))
                     .select(F.struct("article_id", "nom_complet").alias("_of"), F.col("_au").alias("_by"), "_w", "_first",
                             "_kind"), "placed-authors")

    def rows(kind):
        met = (F.col("_by") == F.col("_au")) & F.col("_of.nom_complet").eqNullSafe(F.col("nom_complet"))
        return placed.where(F.col("_kind") == kind).join(never_broadcast(line), met)

    copies = F.col("_w") * F.col("_n")
    pos = [rows("alone").select("_of", "institution", "country", copies.alias("_copies"),
                                (F.col("_first") + F.col("_w") * F.col("_in")).alias("_pos"))]
    # a list that authors share is put in order again: a short one in a task, a long one over many
    short = (rows("merged").select("_of", "_first", "institution", "country", copies.alias("_copies"))
             .repartition("_of").groupBy("_of", "_first", "institution", "country").agg(F.sum("_copies").alias("_copies")))
    before = Window.partitionBy("_of").orderBy("institution", "country").rowsBetween(Window.unboundedPreceding, -1)
    pos.append(short.select("_of", "institution", "country", "_copies",
                            (F.col("_first") + F.coalesce(F.sum("_copies").over(before), F.lit(0))).alias("_pos")))
    if not placed.where(F.col("_kind") == "spread").isEmpty():
        long = rows("spread").groupBy("_of", "_first", "institution", "country").agg(F.sum(copies).alias("_copies"))
        long = sequence_numbers(long, ["institution", "country"], key="_of", out="_in", start=0, weight="_copies")
        pos.append(long.select("_of", "institution", "country", "_copies", (F.col("_first") + F.col("_in")).alias("_pos")))
    return reduce(DataFrame.unionByName, pos).select(
        "_of.article_id", "_of.nom_complet", "institution", "country",
        F.explode(F.sequence(F.col("_pos"), F.col("_pos") + F.col("_copies") - 1)).alias("pos"))


def articles_by_year_and_author(articles: DataFrame, authors: DataFrame, article_author: DataFrame,
                                year_start, year_end, needle: str | None) -> DataFrame:
    """P14 + P15 applied to the whole corpus rather than to a hit list:
    articles whose year passes the inclusive, null-tolerant range and that
    have an author whose name contains ``needle`` (case-insensitive; an empty
    needle keeps every article; a NULL name never matches, Q18).

    ``articles``: (article_id, date_publication). The matching articles are
    found by a semi join against the bridge, so no author list is built."""
    from ..functions.text import contains_ci, year_passes
    out = articles.where(year_passes(year_of("date_publication"), year_start, year_end))
    if not needle:
        return out
    names = authors.where(F.coalesce(contains_ci("nom_complet", needle), F.lit(False))).select(
        F.col("id").alias("_aid"))
    bridge = article_author.select(F.col("article_id").alias("_art"), F.col("auteur_id").alias("_au"))
    matching = bridge.join(names, F.col("_au") == F.col("_aid"), "left_semi")
    return out.join(matching, F.col("article_id") == F.col("_art"), "left_semi")


def retrieval_corpus(articles: DataFrame, drop_blank: bool = False) -> DataFrame:
    """S4 + P11 + P22: the articles that can be embedded: abstract NOT NULL
    (a blank abstract passes unless ``drop_blank``)."""
    cols = ["id", "scopus_id", "titre", "resume", "date_publication", "revue", "doi",
            "mots_cles", "domaine_recherche"]
    out = articles.select(*cols).where(F.col("resume").isNotNull())
    if drop_blank:
        out = out.where(F.rtrim("resume") != "")
    return out
