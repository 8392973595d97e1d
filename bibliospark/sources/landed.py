"""Landed JSON sources (S1, S2, S3) and the JSON sink (K1).

* :func:`read_documents` - landed article documents, JSON Lines with an
  explicit order column, or whole-file JSON arrays (ordinal kept).
* :func:`pages_until_error` / :func:`enrich` - the paged search harvest and
  the per-id detail retrieval, re-aimed at landed responses.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import sequence_numbers
from ..session import ensure_checkpoint_dir, written

# The prefix removed from document identifiers; the top key of a
# landed document.
ID_PREFIX = "SCOPUS_ID:"
RESPONSE = "abstracts-retrieval-response"


# ----------------------------------------------------------------- S3 -----

def read_documents(spark: SparkSession, path: str, fmt: str = "jsonl") -> DataFrame:
    """Landed documents as ``(seq, value)``, in file order.

    ``jsonl``: one JSON document per line; files are split over tasks, so this
    is the form for large inputs. ``array``: each file is one JSON array (the
    harvest's format). Its elements are parsed one by one, in file order, each
    into a row, so no value holds the file and no limit on a value's size
    applies to it; one file is still one task. A repeated key of an object
    keeps its last value. An array with elements that are not objects is
    parsed again, whatever its size, each element into a value of its own, so
    that those are records of their own (cleaning rejects them). A file that is
    not a JSON array to its end fails the read: nothing but a lone comma behind it
    is dropped in silence."""
    if fmt == "jsonl":
        df = spark.read.text(path).select(F.input_file_name().alias("_file"), F.col("value"),
                                          F.monotonically_increasing_id().alias("_pos"), F.lit(0).alias("_item"))
        ensure_checkpoint_dir(spark)
        return _in_file_order(df.checkpoint())
    if fmt != "array":
        raise ValueError(fmt)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # a file that is no array of objects gives a row without a document; its text is never one value
    rows = spark.read.schema(f"`{RESPONSE}` variant").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"),
                       F.to_json(RESPONSE).alias("_doc"))
    rows = rows.checkpoint()  # parsed once; a value may be too large for a Parquet batch
    again = [r["_file"] for r in rows.where(F.col("_doc").isNull()).select("_file").distinct().collect()]  # names alone
    value = F.concat(F.lit('{"' + RESPONSE + '":'), F.coalesce("_doc", F.lit("null")), F.lit("}"))
    good = rows.where(~F.col("_file").isin(again)).select("_file", "_pos", F.lit(0).alias("_item"), value.alias("value"))
    if again:
        # pieces between commas, so that no value holds a file; put together in file order
        pieces = (spark.read.text(path, lineSep=",").where(F.col("_metadata.file_path").isin(again))
                  .select(F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_pos"), "value"))
        items = (pieces.repartition("_file").sortWithinPartitions("_file", "_pos")
                 .mapInArrow(_elements, "_file string, _pos long, _item int, value string"))
        failed = F.raise_error(F.concat(F.lit("not a readable JSON array: "), F.col("_file"))).cast("string")
        good = good.unionByName(items.withColumn(
            "value", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(failed)))
        good = good.checkpoint()
    return _in_file_order(good)


def _in_file_order(rows: DataFrame) -> DataFrame:
    """(seq, value) of the checkpointed rows (_file, _pos, _item, value), numbered from 1
    by file and place in it. ``_pos`` is a row's id by task and place in the task,
    so the rows of a file and task follow each other: one count and the first id of
    each are numbered and broadcast - as many as the driver listed files and planned
    tasks - and no value is sorted or moved, whatever Spark takes its size for."""
    run = F.shiftright("_pos", 33).alias("_run")
    sizes = rows.groupBy("_file", run).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_p0"), F.min("_item").alias("_i0"))
    firsts = sequence_numbers(sizes, ["_file", "_run"], out="_first", weight="_n").select(
        F.col("_file").alias("_f"), F.col("_run").alias("_r"), "_first", "_p0", "_i0")
    at = F.col("_first") + (F.col("_pos") - F.col("_p0")) + (F.col("_item") - F.col("_i0"))
    return (rows.join(F.broadcast(firsts), (F.col("_file") == F.col("_f")) & (F.shiftright("_pos", 33) == F.col("_r")))
            .select(at.cast("long").alias("seq"), "value"))


_MARK = re.compile(r'["\\\[\]{}]')


def _elements(batches):
    """(_file, _pos, _item, value): the elements of the JSON array that the pieces
    (_file, _pos, value) between the commas of each file make up; a null value where
    the array does not end or something follows it."""
    file, out = None, []

    def flush():
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int64()),
             pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())],
            ["_file", "_pos", "_item", "value"])

    depth = item = 0
    quoted = ended = False
    held: list[str] = []
    for b in batches:
        for name, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if name != file:
                if file is not None and not ended:
                    out.append((file, item, None))
                file, depth, item, quoted, ended, held = name, 0, 0, False, False, []
            elif depth == 1 and not quoted:
                out.append((file, item, "".join(held)))
                item, held = item + 1, []
            elif ended:
                piece = "," + piece
            else:
                held.append(",")
            start = skip = 0
            for mark in _MARK.finditer(piece):
                at, c = mark.start(), mark.group()
                if at < skip or ended:
                    continue
                if quoted:
                    if c == "\\":
                        skip = at + 2
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c in "[{":
                    depth += 1
                    if depth == 1:  # the array itself
                        if piece[:at].strip() or c == "{":
                            out.append((file, item, None))
                        start = at + 1
                elif c in "]}":
                    depth -= 1
                    if depth == 0:
                        held.append(piece[start:at])
                        last = "".join(held)
                        if last.strip() or item:  # an empty array has none
                            out.append((file, item, last))
                        ended, start, held = True, at + 1, []
            if ended:
                if piece[start:].strip():
                    out.append((file, item, None))
            else:
                held.append(piece[start:])
        if out:
            yield flush()
    if file is not None and not ended:
        out.append((file, item, None))
    if out:
        yield flush()


def write_json(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """K1: JSON sink that keeps null fields (``"orcid": null``); Spark drops
    them by default."""
    df.write.mode(mode).option("ignoreNullFields", False).option("compression", compression).json(path)


# -------------------------------------------------------------- S1, S2 -----

def pages_until_error(pages: DataFrame) -> DataFrame:
    """S1 + L5 + U1: search entries of the landed result pages, keeping only
    pages before the first non-200 page (the harvest stops there).

    ``pages``: (start int, status int, body string). Returns (start, pos,
    entry) with ``entry`` a VARIANT; a page without ``entry`` adds nothing."""
    stop = pages.where(F.col("status") != 200).agg(F.min("start")).first()[0]  # a scalar
    ok = pages.where(F.col("status") == 200)
    if stop is not None:
        ok = ok.where(F.col("start") < F.lit(stop))
    entries = F.try_variant_get(F.try_parse_json("body"), "$['search-results']['entry']", "array<variant>")
    return ok.select("start", F.posexplode_outer(entries).alias("pos", "entry")).where(F.col("entry").isNotNull())


def entry_id(entry: Column) -> Column:
    """T3 + T1: identifier of a search entry with the prefix removed."""
    raw = F.try_variant_get(entry, "$['dc:identifier']", "string")
    return F.replace(F.coalesce(raw, F.lit("")), F.lit(ID_PREFIX), F.lit(""))


def enrich(entries: DataFrame, details: DataFrame) -> DataFrame:
    """S2 + J6 + P18: detail documents of the harvested entries.

    ``entries``: (start, pos, entry); ``details``: (scopus_id, landed, status,
    body), ``landed`` the order of landing. Blank ids are skipped and only 200
    responses count. An id listed twice is fetched (kept) twice; an entry gets
    one document, the first that landed for its id. The harvest order (start,
    pos) is kept. Only keys are aggregated, never the documents."""
    ids = entries.select("start", "pos", entry_id(F.col("entry")).alias("scopus_id")).where(F.col("scopus_id") != "")
    ok = written(details.where(F.col("status") == 200).select("scopus_id", "landed", "body"), "details")
    first = ok.groupBy("scopus_id").agg(F.min("landed").alias("landed"))
    wanted = ids.join(first, "scopus_id")
    return wanted.join(ok, ["scopus_id", "landed"]).select("start", "pos", "scopus_id", F.col("body").alias("value"))


# Fixed value: the smoke search's default for a missing field.
NOT_AVAILABLE = "Non disponible"


def smoke_projection(entries: DataFrame, count: int = 5) -> DataFrame:
    """S5 + P19: the first ``count`` entries of the search in relevance
    (harvest) order with title, creator, date and DOI; a missing key shows
    ``NOT_AVAILABLE`` (a present null does not)."""
    w = F.row_number().over(Window.orderBy("start", "pos"))

    def field(key):
        v = F.try_variant_get(F.col("entry"), f"$['{key}']", "variant")
        return F.when(v.isNull(), F.lit(NOT_AVAILABLE)).otherwise(
            F.try_variant_get(F.col("entry"), f"$['{key}']", "string"))

    top = entries.orderBy("start", "pos").limit(count)  # the feature: a top-5 search
    return top.select(w.cast("long").alias("rank"), field("dc:title").alias("title"),
                      field("dc:creator").alias("creator"), field("prism:coverDate").alias("date"),
                      field("prism:doi").alias("doi"))
