"""The pipeline, stage by stage, against the operators' brute-force versions."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from test_line_dedup import brute as brute_lines
from test_native_rules import base_figures, brute_hits
from test_packing import check
from test_simhash import brute_fp, brute_groups

SF = "/root/testdata/sf0.001"


def norm(line):
    return re.sub(r"[ \t\x0b\f\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ")


def brute_quality(docs):
    """docs: {id: (text, source)}"""
    hosts, seen = Counter(), Counter()
    for text, source in set(docs.values()):
        hosts[source] += 1
        seen.update({(source, norm(x)) for x in text.split("\n") if norm(x)})
    kept = {}
    for d, (text, source) in docs.items():
        n, chars, _, _, repeat = base_figures(text)
        lost = sum(len(norm(x).replace(" ", "")) for x in text.split("\n")
                   if norm(x) and seen[(source, norm(x))] >= max(10, 0.05 * hosts[source]))
        if not (n < 50 or 100 * repeat > 50 * n or lost > 0.5 * chars):
            kept[d] = (text, source)
    return kept


def brute_strip(docs):
    gone = {k for k, v in brute_lines([(d, t) for d, (t, _) in docs.items()], 2, 40).items() if v[3]}
    out = {}
    for d, (t, s) in docs.items():
        rest = "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)
        left, before = (len(re.sub(r"[ \t\n\x0b\f\r]", "", x)) for x in (rest, t))
        if rest == t or left and left >= 0.2 * before:
            out[d] = (rest, s)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, stages):
    rows = [{r.doc_id: (r.text, r.source) for r in d.collect()} for d in stages[:-1]]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert rows[1] == brute_quality(rows[0])
    assert rows[2] == brute_strip(rows[1])
    groups = brute_groups({d: brute_fp(t) for d, (t, _) in rows[2].items()})
    assert rows[3] == {d: v for d, v in rows[2].items() if groups[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[4] == {d: v for d, v in rows[3].items() if not brute_hits(v[0], items)[4]}
    assert all(len(a) > len(b) > 50 for a, b in zip(rows[:2], rows[1:]))
    assert all(len(a) >= len(b) for a, b in zip(rows[1:], rows[2:]))
    pieces = stages[-1].collect()
    short, shards = check(pieces, [(d, t) for d, (t, _) in rows[4].items()], 2048)
    assert short <= shards


def test_run_returns_the_last_stage(spark, stages):
    a = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.offset) for r in corpus_pipeline.run(spark, SF).collect())
    assert a == sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.offset) for r in stages[-1].collect())


def test_planted_cases_and_edge_rows(spark, tmp_path, docs_of):
    words = [f"w{i}" for i in range(4000)]
    clean = [(i, " ".join(words[i * 70:i * 70 + 65]) + f"\nend of document number {i}") for i in range(40)]
    leak = " ".join(words[3500:3540])
    rows = clean + [(100, " ".join(words[3000:3060]) + " " + leak), (101, clean[3][1]), (102, clean[3][1]),
                    (103, None), (104, ""), (105, "too short"), (106, "a b c " * 60), (None, " ".join(words[3100:3190]))]
    docs = docs_of(rows)
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in docs.collect()) == [-1, *range(40)]
    assert docs.columns == docs_of([]).columns
    empty = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
