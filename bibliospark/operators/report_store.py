"""Reports kept up to date by deltas (A1-A4): counts are merged, not recounted.

A store holds signed counts per report key, one partition per delta:

* ``counts`` (report, key, n): articles per publication date and per domain,
  bridge rows per author and per affiliation;
* ``pairs`` (auteur_id, affiliation_id, n): the bridge as a bag, for the report
  that counts each pair once;
* ``deltas``: one row per delta, written last.

A delta is any set of rows with a ``sign`` of 1 (inserted) or -1 (deleted); an
update is one of each. It is aggregated by key first (map-side, so a hot author is
one row a task) and appended, and a report sums the partitions: it reads a row per
key and delta instead of the bridges. Every ``MERGE`` deltas the counts so far are
rewritten as one partition without the keys that are back at zero. Reports are
those of ``operators.reports``, names and countries joined at reading, so a
renamed author needs no delta.

Deletes of rows that were never inserted leave a negative count, which no report
shows. A delta that fails leaves files that no reader sees and the next one writes
over; of two at once one fails at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.text import year_of
from ..session import ensure_checkpoint_dir
from . import reports as R

#: Deltas after which the counts are rewritten as one partition.
MERGE = 16

_SCHEMAS = {"counts": "report string, key string, n long", "pairs": "auteur_id long, affiliation_id long, n long",
            "deltas": "base int"}
_KEYS = {"counts": ["report", "key"], "pairs": ["auteur_id", "affiliation_id"]}


class ReportStore:
    """Counts under ``path`` that grow by deltas."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        ensure_checkpoint_dir(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> ReportStore:
        """A new, empty store; fails where one stands already."""
        store = cls(spark, path)
        for name in _KEYS:
            store._write(spark.createDataFrame([], _SCHEMAS[name]), name, 0)
        store._commit(0, 0)
        return store

    def _write(self, df: DataFrame, name: str, delta: int) -> None:
        # over what a failed delta may have left
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/delta={delta}")

    def _commit(self, delta: int, base: int) -> None:
        rows = self.spark.createDataFrame([Row(base=base)], _SCHEMAS["deltas"]).coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.path}/deltas/delta={delta}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{_SCHEMAS[name]}, delta int").parquet(f"{self.path}/{name}")

    def last(self) -> Row:
        """The last delta: its number and the first one that still counts."""
        return self._read("deltas").orderBy(F.desc("delta")).first()

    def _merged(self, name: str) -> DataFrame:
        """The counts of all deltas, keys at zero left out."""
        last = self.last()
        rows = self._read(name).where(F.col("delta").between(last["base"], last["delta"]))
        return rows.groupBy(*_KEYS[name]).agg(F.sum("n").alias("n")).where("n <> 0")

    # -- deltas --

    def apply(self, articles: DataFrame | None = None, article_author: DataFrame | None = None,
              author_affiliation: DataFrame | None = None) -> None:
        """Add a delta: rows of articles (date_publication, domaine_recherche, sign)
        and of the bridges (auteur_id, sign), (auteur_id, affiliation_id, sign)."""
        last = self.last()
        n = last["delta"] + 1

        def counted(rows: DataFrame, report: str, key: Column) -> DataFrame:
            return (rows.groupBy(key.cast("string").alias("key")).agg(F.sum("sign").cast("long").alias("n"))
                    .where("n <> 0").select(F.lit(report).alias("report"), "key", "n"))

        counts = [self.spark.createDataFrame([], _SCHEMAS["counts"])]
        pairs = self.spark.createDataFrame([], _SCHEMAS["pairs"])
        if articles is not None:
            domain = F.col("domaine_recherche")
            counts += [counted(articles, "date", F.col("date_publication")),
                       counted(articles.where(R.has_domain(domain)), "domain", domain)]
        if article_author is not None:
            counts.append(counted(article_author, "author", F.col("auteur_id")))
        if author_affiliation is not None:
            counts.append(counted(author_affiliation, "affiliation", F.col("affiliation_id")))
            pairs = (author_affiliation.groupBy("auteur_id", "affiliation_id").agg(F.sum("sign").cast("long").alias("n"))
                     .where("n <> 0"))
        counts = reduce(DataFrame.unionByName, counts)
        base = last["base"]
        if n - base >= MERGE:  # this partition holds everything so far
            counts = self._merged("counts").unionByName(counts).groupBy("report", "key").agg(F.sum("n").alias("n")).where("n <> 0")
            pairs = self._merged("pairs").unionByName(pairs).groupBy(*_KEYS["pairs"]).agg(F.sum("n").alias("n")).where("n <> 0")
            base = n
        self._write(counts, "counts", n)
        self._write(pairs, "pairs", n)
        self._commit(n, base)

    # -- reports --

    def _of(self, report: str) -> DataFrame:
        return self._merged("counts").where((F.col("report") == report) & (F.col("n") > 0))

    def publications_by_date(self, granularity: str = "date") -> DataFrame:
        """A1 + L2, as ``reports.publications_by_date``."""
        if granularity not in ("date", "year"):
            raise ValueError("granularity must be 'date' or 'year'")
        counts = self._of("date")
        key = F.col("key") if granularity == "date" else year_of("key")
        return (counts.groupBy(key.alias("year")).agg(F.sum("n").alias("total")).orderBy(F.col("year").asc_nulls_first()))

    def top_domains(self, k: int = 10, collation: str | None = None) -> DataFrame:
        """A2, as ``reports.top_domains``."""
        return R.ranked_domains(self._of("domain").select(F.col("key").alias("domaine_recherche"), "n"), k, collation)

    def top_authors(self, authors: DataFrame, k: int = 10, by: str = "name", collation: str | None = None) -> DataFrame:
        """A3, as ``reports.top_authors``."""
        counts = self._of("author").select(F.col("key").cast("long").alias("auteur_id"), "n")
        return R.ranked_authors(counts, authors, k, by, collation)

    def top_countries(self, affiliations: DataFrame, k: int = 10, distinct: bool = False,
                      collation: str | None = None) -> DataFrame:
        """A4, as ``reports.top_countries``."""
        if distinct:
            counts = self._merged("pairs").where("n > 0").groupBy("affiliation_id").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = self._of("affiliation").select(F.col("key").cast("long").alias("affiliation_id"), "n")
        return R.ranked_countries(counts, affiliations, k, collation)
