"""Landed JSON built from the tables, for the queries that read landed JSON.

The relational star is encoded into landed documents, paged search responses
and detail responses, so that those queries run on data that grows with the
tables, and cleaning must give back the relational rows (a round trip).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.landed import ID_PREFIX
from ..sources.tables import Catalog


def _quoted(c: Column) -> Column:
    """A string as a JSON string literal (quoted and escaped)."""
    arr = F.to_json(F.array(c))
    return F.substring(arr, F.lit(2), F.length(arr) - 2)


def _one_or_many(items: Column) -> Column:
    """A JSON list of objects: the bare object when there is exactly one."""
    return F.when(F.size(items) == 1, F.get(items, 0)).otherwise(
        F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def documents_from_tables(spark: SparkSession, base: str, extra: tuple = ()) -> DataFrame:
    """(seq, value): one landed document per order, encoding its lines as
    authors (part), their affiliations (supplier, nation), keywords (part
    type) and research domain (the order's document source).

    Shapes vary with the data: a single author/affiliation/keyword is an
    object, several are an array; an order without lines carries the string
    placeholders the API uses; author affiliation refs alternate between an
    object and a one-element array by line number. Two rare status/priority
    combinations carry type errors (a numeric title; a null keyword list),
    so the reject path is exercised on real rows. ``extra``: order columns to
    carry along."""
    cat = Catalog(spark, base)
    o = cat.orders.select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    d = cat.documents.select("doc_id", "text", "source", "lang")
    p = cat.part.select("p_partkey", "p_name", "p_type", "p_brand")
    s = cat.supplier.select("s_suppkey", "s_name", "s_nationkey")
    n = cat.nation.select("n_nationkey", "n_name")
    li = cat.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    sup = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")  # nation: 25 rows
    # the parts last: their names are the longest, and each join deals the lines anew
    lines = (li.join(sup, li.l_suppkey == sup.s_suppkey, "left")
             .join(p, li.l_partkey == p.p_partkey, "left"))
    lines = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_type", "p_brand", "s_name", "n_name")

    # a line's author, affiliation and keyword as JSON
    c = F.col
    given = F.substring_index(c("p_name"), " ", 1)
    cut = F.instr(c("p_name"), F.lit(" "))
    surname = F.when(cut > 0, F.substring(c("p_name"), cut + 1, F.length(c("p_name")))).otherwise(F.lit(""))
    ref_obj = F.to_json(F.struct(c("l_suppkey").cast("string").alias("@id")))
    ref = F.when(c("l_linenumber") % 2 == 1, ref_obj).otherwise(F.concat(F.lit("["), ref_obj, F.lit("]")))
    person = F.to_json(F.struct(
        c("l_partkey").cast("string").alias("@auid"),
        given.alias("ce:given-name"), surname.alias("ce:surname"), c("p_brand").alias("orcid")))
    author = F.concat(F.substring(person, F.lit(1), F.length(person) - 1), F.lit(',"affiliation":'), ref, F.lit("}"))
    block = F.to_json(F.struct(
        c("l_suppkey").cast("string").alias("@id"), c("s_name").alias("affilname"),
        c("n_name").alias("affiliation-country")))
    written_out = F.struct("l_linenumber", "l_partkey", "l_suppkey", author.alias("_author"),
                           F.to_json(F.struct(c("p_type").alias("$"))).alias("_kw"), block.alias("_blk"))

    # one document per order: bounded by the lines of one order. The lines are
    # dealt once, as plain columns, and become JSON there, row by row before they
    # are collected: expressions over rows are compiled, those within lists are
    # not. Line numbers repeat within an order, so the line order is (line, part,
    # supplier).
    agg = (lines.repartition("l_orderkey").select("l_orderkey", written_out.alias("_line"))
           .groupBy("l_orderkey").agg(F.sort_array(F.collect_list("_line")).alias("_lines")))
    agg = agg.withColumn("_blocks", F.sort_array(F.array_distinct(
        F.arrays_zip(c("_lines.l_suppkey").alias("l_suppkey"), c("_lines._blk").alias("_blk")))))
    authors, kws, blocks = c("_lines._author"), c("_lines._kw"), c("_blocks._blk")

    j = (o.join(d, o.o_orderkey == d.doc_id, "left")
         .join(agg, o.o_orderkey == agg.l_orderkey, "left"))
    has_lines = F.col("_lines").isNotNull()
    bad_title = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    null_kw = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "2-HIGH")
    title = F.when(bad_title, (F.col("o_orderkey") + 1).cast("string")).otherwise(
        _quoted(F.concat(F.lit("  Article "), F.col("o_orderkey").cast("string"), F.lit("\n"))))
    core = F.concat(F.expr("substring(_core, 1, length(_core) - 1)"), F.lit(',"dc:title":'), title, F.lit("}"))
    kw_json = (F.when(null_kw, F.lit("null"))
               .when(has_lines, _one_or_many(kws)).otherwise(F.lit('""')))
    # subject areas: a bare object for finished orders, the domain followed by
    # the document language for open ones, a one-element list otherwise
    area = F.concat(F.lit('{"@abbrev":'), _quoted(F.col("source")), F.lit("}"))
    second = F.concat(F.lit('{"@abbrev":'), _quoted(F.coalesce(F.col("lang"), F.lit(""))), F.lit("}"))
    areas = (F.when(F.col("o_orderstatus") == "F", area)
             .when(F.col("o_orderstatus") == "O", F.concat(F.lit("["), area, F.lit(","), second, F.lit("]")))
             .otherwise(F.concat(F.lit("["), area, F.lit("]"))))
    subject = F.when(F.col("source").isNotNull(), F.concat(
        F.lit(',"subject-areas":{"subject-area":'), areas, F.lit("}")))
    doc = F.concat(
        F.lit('{"abstracts-retrieval-response":{"coredata":'), F.col("_coredata"),
        F.lit(',"authkeywords":{"author-keyword":'), kw_json, F.lit("}"),
        F.coalesce(subject, F.lit("")),
        F.lit(',"authors":{"author":'),
        F.when(has_lines, _one_or_many(authors)).otherwise(F.lit('""')),
        F.lit('},"affiliation":'),
        F.when(has_lines, _one_or_many(blocks)).otherwise(F.lit('""')),
        F.lit("}}"))
    staged = j.withColumn("_core", F.to_json(F.struct(
        F.concat(F.lit(ID_PREFIX), F.col("o_orderkey").cast("string")).alias("dc:identifier"),
        F.col("text").alias("dc:description"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("prism:coverDate"),
        F.col("o_orderpriority").alias("prism:publicationName"),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(F.lit("10.5555/"), F.col("o_orderkey").cast("string"))).otherwise(F.lit(""))
        .alias("prism:doi"))))
    staged = staged.withColumn("_coredata", core)
    return staged.select(F.col("o_orderkey").alias("seq"), doc.alias("value"), *extra)


PAGE_SIZE = 25  # entries per search page (the harvest's page size)


def search_pages_from_tables(spark: SparkSession, base: str) -> DataFrame:
    """(start, status, body): the orders as paged search responses of
    ``PAGE_SIZE`` entries in key order. In the last tenth of the keys, a page
    whose first order is urgent answers 429 (rate limited), so that the
    harvest reads most pages; an entry of an open low-priority
    order has a blank identifier; ``dc:creator`` and ``prism:doi`` are only
    present for finished orders. Each page holds at most ``PAGE_SIZE``
    entries, so the per-page collect is bounded."""
    o = Catalog(spark, base).orders.select("o_orderkey", "o_custkey", "o_orderdate",
                                           "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey").cast("string")
    finished = F.col("o_orderstatus") == "F"
    entry = F.to_json(F.struct(
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), F.lit(""))
        .otherwise(F.concat(F.lit(ID_PREFIX), key)).alias("dc:identifier"),
        F.concat(F.lit("Article "), key).alias("dc:title"),
        F.when(finished, F.concat(F.lit("Creator "), F.col("o_custkey").cast("string"))).alias("dc:creator"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("prism:coverDate"),
        F.when(finished, F.concat(F.lit("10.5555/"), key)).alias("prism:doi")))
    last = o.agg(F.max("o_orderkey")).first()[0] or 0  # a scalar
    first_bad = (F.col("o_orderkey") * 10 >= F.lit(last) * 9) & (F.col("o_orderpriority") == "1-URGENT")
    pages = (o.select(F.expr(f"o_orderkey div {PAGE_SIZE}").alias("page"),
                      F.struct("o_orderkey", entry.alias("e"), first_bad.alias("bad")).alias("x"))
             .groupBy("page").agg(F.array_sort(F.collect_list("x")).alias("xs")))
    body = F.concat(F.lit('{"search-results":{"entry":['),
                    F.array_join(F.transform("xs", lambda x: x["e"]), ","), F.lit("]}}"))
    status = F.when(F.get(F.col("xs"), 0)["bad"], F.lit(429)).otherwise(F.lit(200))
    return pages.select((F.col("page") * PAGE_SIZE).cast("long").alias("start"), status.alias("status"),
                        body.alias("body"))


def details_from_tables(spark: SparkSession, base: str) -> DataFrame:
    """(scopus_id, landed, status, body): the detail response per order;
    pending medium-priority orders answer 404, and finished orders answer
    twice, the second time with an empty document."""
    docs = documents_from_tables(spark, base, extra=("o_orderstatus", "o_orderpriority"))
    missing = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "3-MEDIUM")
    again = F.when(F.col("o_orderstatus") == "F", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (docs.withColumn("landed", F.explode(again))
            .select(F.col("seq").cast("string").alias("scopus_id"), "landed",
                    F.when(missing, F.lit(404)).otherwise(F.lit(200)).alias("status"),
                    F.when(F.col("landed") == 1, F.col("value")).otherwise(F.lit("{}")).alias("body")))
