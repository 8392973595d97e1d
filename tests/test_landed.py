"""Landed JSON sources: lossless array files, enrichment, numbering of null keys."""

import json

import pytest

from bibliospark.functions.sequence import sequence_numbers
from bibliospark.operators import extract as X
from bibliospark.sources import landed


def document(k, **core):
    return {landed.RESPONSE: {"coredata": {"dc:identifier": f"SCOPUS_ID:{k}", "dc:title": f"T{k}", **core},
                              "authors": {"author": ""}, "affiliation": "", "authkeywords": {"author-keyword": ""}}}


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def read(spark, path, fmt="array"):
    return landed.read_documents(spark, path, fmt).orderBy("seq").collect()


def test_array_above_the_value_limit_keeps_every_row(spark, tmp_path):
    # 150 MB in one array: more than one VARIANT value may hold
    filler = "x" * 100_000
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",\n".join(json.dumps(document(k, **{"dc:description": filler})) for k in range(1500)) + "]")
    rows = landed.read_documents(spark, str(tmp_path / "big.json"), "array")
    clean = X.clean(rows).select("seq", "scopus_id").orderBy("seq").collect()
    assert [r.scopus_id for r in clean] == [str(k) for k in range(1500)]


def test_truncated_file_raises(spark, tmp_path):
    text = json.dumps([document(k) for k in range(5)])
    path = write(tmp_path / "cut.json", text[:-40])
    with pytest.raises(Exception, match="not a readable JSON array"):
        read(spark, path)


def test_elements_that_are_no_objects_are_rejected_one_by_one(spark, tmp_path):
    path = write(tmp_path / "mixed.json", json.dumps([document(1), 5, "text", None, [1], {"other": 1}, document(2)]))
    rows = landed.read_documents(spark, path, "array")
    assert [r.seq for r in rows.orderBy("seq").collect()] == list(range(1, 8))
    assert [r.scopus_id for r in X.clean(rows).orderBy("seq").collect()] == ["1", "2"]


def test_a_large_mixed_array_keeps_its_good_elements(spark, tmp_path):
    # 140 MB with four elements that are no objects: more than one VARIANT value may hold
    filler = "x" * 100_000
    items = [document(k, **{"dc:description": filler}) for k in range(1400)]
    items[3:3] = [5, '{"a": [1, "}"], \\\\" ,]']
    with open(tmp_path / "big.json", "w") as f:
        f.write("[" + ",\n".join(map(json.dumps, items + [None, [1]])) + "]\n")
    rows = landed.read_documents(spark, str(tmp_path / "big.json"), "array")
    assert rows.count() == 1404
    assert [r.scopus_id for r in X.clean(rows).select("seq", "scopus_id").orderBy("seq").collect()] == [
        str(k) for k in range(1400)]


@pytest.mark.parametrize("text", ['[1, 2', '[{"a": 1}, 5] x', '[5, {"a": 1}', '[5, "x]', '[1,, 2]', '[1, 2,]', '[1] [2]'])
def test_no_array_to_its_end_raises(spark, tmp_path, text):
    with pytest.raises(Exception, match="not a readable JSON array"):
        read(spark, write(tmp_path / "bad.json", text))


def test_repeated_keys_keep_the_last_value(spark, tmp_path):
    one = json.dumps(document(1)).replace('"dc:title": "T1"', '"dc:title": "first", "dc:title": "last"')
    for fmt, text in (("array", f"[{one}]"), ("jsonl", one)):
        path = write(tmp_path / f"dup.{fmt}", text)
        assert [r.titre for r in X.clean(landed.read_documents(spark, path, fmt)).collect()] == ["last"]


def test_lines_keep_file_order_over_files(spark, tmp_path):
    for part in range(3):
        write(tmp_path / f"part-{part}.txt", "\n".join(json.dumps(document(part * 10 + k)) for k in range(10)))
    ids = [json.loads(r.value)[landed.RESPONSE]["coredata"]["dc:title"] for r in read(spark, str(tmp_path), "jsonl")]
    assert ids == [f"T{k}" for k in range(30)]


def test_enrichment_gives_an_entry_one_document(spark):
    entry = lambda k: json.dumps({"dc:identifier": k})
    entries = spark.createDataFrame([(0, 0, entry("SCOPUS_ID:1")), (0, 1, entry("SCOPUS_ID:1")), (0, 2, entry("")),
                                     (25, 0, entry("SCOPUS_ID:2")), (25, 1, entry("SCOPUS_ID:3"))],
                                    "start long, pos int, e string").selectExpr("start", "pos", "parse_json(e) as entry")
    details = spark.createDataFrame([("1", 7, 200, "later"), ("1", 3, 200, "first"), ("1", 1, 404, "error"),
                                     ("2", 1, 500, "gone"), ("3", 1, 200, "third"), ("", 1, 200, "blank")],
                                    "scopus_id string, landed long, status int, body string")
    got = sorted(tuple(r) for r in landed.enrich(entries, details).collect())
    assert got == [(0, 0, "1", "first"), (0, 1, "1", "first"), (25, 1, "3", "third")]


def test_numbering_keeps_null_keys(spark):
    rows = [(None, 3), (None, 1), (5, 2), (5, 9), (None, 8)]
    got = sequence_numbers(spark.createDataFrame(rows, "k long, t long"), ["t"], key="k", out="n").collect()
    assert sorted((r.k or 0, r.t, r.n) for r in got) == [(0, 1, 1), (0, 3, 2), (0, 8, 3), (5, 2, 1), (5, 9, 2)]


def test_values_are_numbered_where_they_lie(spark, tmp_path):
    # several files and tasks; the values are not sorted a second time
    path, spark_bytes = str(tmp_path / "lines"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = spark.range(300).selectExpr("id", "concat('{\"n\":', id, '}') AS value")
    rows.repartitionByRange(5, "id").sortWithinPartitions("id").select("value").write.option("compression", "gzip").text(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        read = landed.read_documents(spark, path)
        plan = read._jdf.queryExecution().executedPlan().toString()
        got = [tuple(r) for r in read.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", spark_bytes)
    assert got == [(i + 1, f'{{"n":{i}}}') for i in range(300)]
    assert "ExistingRDD[_file" in plan  # the rows as they were read, joined with their files' numbers


def test_sink_may_be_compressed(spark, tmp_path):
    landed.write_json(spark.createDataFrame([(1, None)], "id long, x string"), str(tmp_path / "out"), compression="gzip")
    assert {p.suffix for p in (tmp_path / "out").glob("part-*")} == {".gz"}
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"id":1,"x":null}'


def test_enrich_moves_each_document_once(spark):
    from pyspark.sql import functions as F

    entries = spark.createDataFrame([(0, 0, "SCOPUS_ID:1"), (0, 1, ""), (25, 0, "SCOPUS_ID:2"), (25, 1, "SCOPUS_ID:1"), (25, 2, "SCOPUS_ID:3")],
                                    "start long, pos int, id string")
    entries = entries.select("start", "pos", F.parse_json(F.to_json(F.struct(F.col("id").alias("dc:identifier")))).alias("entry"))
    details = spark.createDataFrame([("1", 1, 404, "gone"), ("1", 2, 200, "a"), ("1", 3, 200, "late"), ("2", 5, 200, "b"),
                                     ("2", 5, 200, "b2"), ("3", 1, 500, "x"), ("4", 1, 200, "unasked"), (None, 1, 200, "no id")],
                                    "scopus_id string, landed int, status int, body string")
    out = landed.enrich(entries, details)
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, 0, "1", "a"), (25, 0, "2", "b"), (25, 0, "2", "b2"), (25, 1, "1", "a")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # no join that picks documents before the one that gives them out
    assert "LeftSemi" not in plan and plan.count("Join Inner") == 2


@pytest.mark.parametrize("fmt", ["array", "jsonl"])
def test_values_are_never_broadcast(spark, tmp_path, fmt):
    # a parsed value has an estimated size far under its own; only the files' numbers may be broadcast
    docs = [json.dumps(document(k, **{"dc:description": "x" * 1000})) for k in range(20)]
    path = write(tmp_path / "docs.json", f"[{','.join(docs)}]" if fmt == "array" else "\n".join(docs))
    rows = landed.read_documents(spark, path, fmt)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted(r.seq for r in rows.collect()) == list(range(1, 21))
