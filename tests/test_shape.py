"""Shape profiles of landed JSON against counts in Python, and planted drift."""

import json
from collections import Counter

from bibliospark.operators.shape import drift, shape_profile

KINDS = {dict: "OBJECT", list: "ARRAY", str: "STRING", int: "NUMBER", float: "NUMBER", bool: "BOOLEAN",
         type(None): "NULL"}


def brute(value, path="$"):
    yield path, KINDS[type(value)]
    if isinstance(value, list):
        for x in value:
            yield from brute(x, path + "[*]")
    elif isinstance(value, dict):
        for k, x in value.items():
            plain = k.isascii() and k.replace("_", "a").isalnum()
            yield from brute(x, path + (f".{k}" if plain else f'."{k}"'))


DOCS = [
    {"a": 1, "b": [1, "x", None, {"c": True}], "d:e": {"f g": 2.5}},
    {"a": "1", "b": {"c": False}, "d:e": None},
    {"a": [[1, 2], []], "b": {}, "é": "ü"},
    [1, {"a": 2}], "text", 7, None, True, {}, [],
]


def profile(spark, texts, **kw):
    return shape_profile(spark.createDataFrame([(t,) for t in texts], "value string"), **kw)


def test_counts_equal_a_walk_in_python(spark):
    texts = [json.dumps(d, ensure_ascii=False) for d in DOCS] * 3
    want = Counter(x for d in DOCS for x in brute(d))
    got = {(r.path, r.kind): r.n for r in profile(spark, texts).collect()}
    assert got == {k: 3 * n for k, n in want.items()}


def test_no_json_and_null_are_invalid(spark):
    got = {(r.path, r.kind): r.n for r in profile(spark, [None, "{", "", '{"a":1,"a":"x"}']).collect()}
    assert got == {("$", "INVALID"): 3, ("$", "OBJECT"): 1, ("$.a", "STRING"): 1}


def test_empty_table(spark):
    assert profile(spark, []).isEmpty()


def test_deep_documents(spark):
    text = "[" * 40 + "1" + "]" * 40
    got = {r.path: r.kind for r in profile(spark, [text]).collect()}
    assert len(got) == 41 and got["$" + "[*]" * 40] == "NUMBER"


def test_planted_drift(spark):
    rows = [("l1", '{"id":1,"same":[1],"old":0}', "x")] * 5 + [("l2", '{"id":"1","same":[2],"fresh":{"k":1}}', "x")] * 5
    docs = spark.createDataFrame(rows + [("l2", '{"id":2,"same":[]}', "x")], "landing string, value string, path string")
    found = {r.path: (r.kinds_before, r.kinds_after, r.change)
             for r in drift(shape_profile(docs, by=("landing",)), "landing", "l1", "l2").collect()}
    assert found == {
        "$.id": ("NUMBER", "NUMBER,STRING", "changed"), "$.old": ("NUMBER", "", "gone"),
        "$.fresh": ("", "OBJECT", "new"), "$.fresh.k": ("", "NUMBER", "new")}
