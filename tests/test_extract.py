"""Cleaning rules of landed documents, one hand-made record per rule."""

import json

import pytest

from bibliospark.operators import extract as X


def doc(core=None, **resp):
    r = {}
    if core is not None:
        r["coredata"] = core
    r.update(resp)
    return {"abstracts-retrieval-response": r}


def run(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "seq long, value string")
    return {r["seq"]: r.asDict(recursive=True) for r in X.validate(df).collect()}


def test_core_fields(spark):
    out = run(spark, [
        doc({"dc:identifier": " SCOPUS_ID:85 ", "dc:title": "\t Title\n",
             "prism:coverDate": "2021-03-04", "prism:doi": ""}),
        doc({"dc:title": 0}),
        doc({"dc:title": 12}),
        doc({"dc:title": {}}),
    ])
    assert out[0]["reject_reason"] is None
    assert out[0]["scopus_id"] == "85" and out[0]["titre"] == "Title"
    assert out[0]["resume"] == "" and out[0]["doi"] == "" and out[0]["date_publication"] == "2021-03-04"
    assert out[1]["reject_reason"] is None and out[1]["titre"] == ""
    assert out[2]["reject_reason"] == "dc:title not a string"
    assert out[3]["reject_reason"] is None and out[3]["titre"] == ""


def test_keywords(spark):
    out = run(spark, [
        doc({}, authkeywords={"author-keyword": {"$": " a "}}),
        doc({}, authkeywords={"author-keyword": "solo "}),
        doc({}, authkeywords={"author-keyword": [{"$": "x"}, {"$": " "}, "bare", {"$": "x"}]}),
        doc({}, authkeywords={"author-keyword": [{"$": None}]}),
        doc({}, authkeywords="text"),
        doc({}, authkeywords={"author-keyword": None}),
        doc({}, authkeywords={"other": 1}),
    ])
    assert out[0]["mots_cles"] == ["a"]
    assert out[1]["mots_cles"] == ["solo"]
    assert out[2]["mots_cles"] == ["x", "x"]
    assert out[3]["reject_reason"] == "keyword value not a string"
    assert out[4]["reject_reason"] == "authkeywords not an object"
    assert out[5]["reject_reason"] == "author-keyword null"
    assert out[6]["mots_cles"] == [] and out[6]["reject_reason"] is None


def test_subject(spark):
    out = run(spark, [
        doc({}, **{"subject-areas": {"subject-area": {"@abbrev": "COMP"}}}),
        doc({}, **{"subject-areas": {"subject-area": [{"@abbrev": "MATH"}, {"@abbrev": "X"}]}}),
        doc({}),
        doc({}, **{"subject-areas": {"subject-area": ["COMP"]}}),
    ])
    assert out[0]["domaine_recherche"] == "COMP"
    assert out[1]["domaine_recherche"] == "MATH"
    assert out[2]["domaine_recherche"] == ""
    assert out[3]["reject_reason"] == "first subject-area not an object"


def test_authors_and_affiliations(spark):
    block = [{"@id": "1", "affilname": "U1", "affiliation-country": "FR"},
             {"@id": "1", "affilname": "dup", "affiliation-country": "XX"},
             {"affilname": "NoId", "affiliation-country": "MA"}]
    out = run(spark, [
        doc({}, authors={"author": "none"}),
        doc({}, authors={"author": {"@auid": " 7 ", "ce:surname": "Doe", "affiliation": {"@id": "1"}}},
            affiliation=block),
        doc({}, authors={"author": [
            {"@auid": "8", "ce:given-name": None, "ce:surname": "X", "affiliation": [{"@id": "9"}, {}]},
            {"@auid": "9", "ce:given-name": "A", "ce:surname": "B"}]}, affiliation=block),
        doc({}, authors={"author": {"@auid": 5}}),
        doc({}, authors={"author": {"@auid": "1", "affiliation": None}}),
        doc({}, authors={"author": {"@auid": "1", "affiliation": {"@id": "1"}}}, affiliation=None),
        doc({}, authors={"author": {"@auid": "1", "affiliation": []}}, affiliation=None),
        doc({}, authors={"author": ["x"]}),
        doc({}, authors={"author": {"@auid": "1", "affiliation": {"@id": "1"}}},
            affiliation=["junk", {"@id": "1"}]),
    ])
    assert out[0]["auteurs"] == [] and out[0]["reject_reason"] is None
    a = out[1]["auteurs"][0]
    assert a["scopus_author_id"] == "7" and a["nom_complet"] == "Doe"
    assert a["affiliations"] == [{"scopus_affiliation_id": "1", "nom_institution": "U1", "pays": "FR"}]
    a0, a1 = out[2]["auteurs"]
    assert a0["nom_complet"] == "X"
    # unknown ref dropped; id-less ref matches the id-less block entry (null-safe)
    assert a0["affiliations"] == [{"scopus_affiliation_id": "", "nom_institution": "NoId", "pays": "MA"}]
    assert a1["nom_complet"] == "A B" and a1["affiliations"] == []
    assert out[3]["reject_reason"] == "author id not a string"
    assert out[4]["reject_reason"] == "author affiliation null"
    assert out[5]["reject_reason"] == "document affiliation not a list"
    assert out[6]["reject_reason"] is None
    assert out[7]["reject_reason"] == "author not an object"
    assert out[8]["reject_reason"] == "affiliation entry not an object"


def test_top_level_and_malformed(spark):
    out = run(spark, ["[1,2]", "{not json", {"abstracts-retrieval-response": None}])
    assert out[0]["reject_reason"] == "top level not an object"
    assert out[1]["reject_reason"] == "malformed json"
    assert out[2]["reject_reason"] is None and out[2]["scopus_id"] == ""


def test_clean_drops_blank_id_and_title(spark):
    rows = [(0, json.dumps(doc({}))), (1, json.dumps(doc({"dc:title": "T"})))]
    df = spark.createDataFrame(rows, "seq long, value string")
    assert [r.seq for r in X.clean(df).collect()] == [1]


def test_plain_documents_agree_with_the_rules(spark, monkeypatch):
    from pyspark.sql import functions as F

    block = [{"@id": "1", "affilname": " U1 ", "affiliation-country": None}, {"@id": "1", "affilname": "dup"}, {"affilname": "NoId"}]
    people = [{"@auid": " 7 ", "ce:given-name": "A", "ce:surname": None, "orcid": " o ", "affiliation": [{"@id": "1"}, {"@id": "9"}, {}]},
              {"ce:surname": "B", "affiliation": {"@id": None}}, {"@auid": "8"}]
    core = {"dc:identifier": " SCOPUS_ID:85 ", "dc:title": " Té\n", "prism:doi": None}
    plain = [
        doc(core, authors={"author": people}, affiliation=block, authkeywords={"author-keyword": [{"$": " a "}, {"$": ""}, {}]}),
        doc(core, authors={"author": people[0]}, affiliation=block[0], authkeywords={"author-keyword": " solo "}),
        doc({"dc:title": 12, "dc:description": ["x"]}, **{"subject-areas": {"subject-area": [3]}}),
        doc({"dc:title": 0}, authkeywords="text"), doc(core, authkeywords={"author-keyword": None}),
        doc(core, authkeywords={"author-keyword": 4}), doc(core, authors={"author": {}}, affiliation=""),
        doc(core, **{"subject-areas": {"subject-area": {"@abbrev": 1}}}), doc(core, **{"subject-areas": {"subject-area": [{"@abbrev": " M "}]}}),
        '{"abstracts-retrieval-response":{"coredata":{"dc:title":"a","dc:title":"b"}}}',
    ]
    left = [doc(core, authors={"author": {"@auid": 5}}), doc(core, authors={"author": [1]}), doc(core, affiliation=None),
            "{not json", "[1]", '{"a":NaN}', '{"a":"\\ud800"}', '{"a":' + "[" * 1500 + "]" * 1500 + "}", '{"a":1e999}', "{} {}"]
    text = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in plain + left]
    assert [X._plain(t.encode()) is not None for t in text] == [True] * len(plain) + [False] * len(left)
    assert X._plain(None) is None and X._plain(b'{"a":"\xff"}') is None
    found = run(spark, text)
    pass_over = X._with_plain
    monkeypatch.setattr(X, "_with_plain", lambda raw: pass_over(raw).withColumn("_plain", F.col("seq") < 0))
    assert run(spark, text) == found
