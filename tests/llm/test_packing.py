import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from bibliospark.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_remembered_chunks_give_the_ids_of_whole_texts(spark, monkeypatch):
    SF001 = "/root/testdata/sf0.001"
    rnd = random.Random(2)
    odd = ["", " ", "  ", "a ", " a", "a  b", "a \n b", "a\n\n  b\tc ", "it's we'll 'S", "<|endoftext|> x <|endoftext|>",
           "x  y　z   w", "é😀 漢字 \x1c a\x1f b \x85 c", "12 345 6", "\r\n \x0b\x0c d"]
    odd += ["".join(rnd.choice("ab'1 \n\t é ") for _ in range(40)) for _ in range(500)]
    odd += [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in encoder.encode(odd)] == reference_ids(odd)
    assert encoder.known
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    assert [x.tolist() for x in encoder.encode(odd)] == reference_ids(odd)
    assert not encoder.known
    monkeypatch.setattr(packing, "REMEMBERED", 10**6)
    monkeypatch.setattr(packing, "IDLE_SECONDS", 0.05)
    assert [x.tolist() for x in encoder.encode(odd)] == reference_ids(odd)
    encoder.rest.join()
    assert not encoder.known


def check(rows, docs, window):
    ids = [x + [1] for x in reference_ids([t or "" for _, t in docs])]
    want = sorted(((d, x) for (d, _), x in zip(docs, ids)), key=lambda p: (p[0] is None, p))
    pieces = {}
    for r in rows:
        assert 0 < r.length and r.offset + r.length <= window
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r.ids)
    got = []
    for (d, n), at in pieces.items():
        copies = max(map(len, at.values()))
        total = sum(len(x) for xs in at.values() for x in xs)
        assert total == n * len([1 for w in want if w[0] == d and len(w[1]) == n])
        del copies
    for (d, x) in want:
        k, at = (d, len(x)), 0
        while at < len(x):
            part = next(p for p in pieces[k][at] if p == x[at:at + len(p)])
            pieces[k][at].remove(part)
            at += len(part)
        got.append((d, x))
    assert not any(xs for at in pieces.values() for xs in at.values())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        short += at < window
    return short, len({s >> 32 for s in sequences})


def test_every_id_in_one_piece(docs_of):
    rnd = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 20, 200, 3000))))) for i in range(80)]
    docs += [(90, None), (91, ""), (None, "no id"), (92, "twice the same"), (92, "twice the same"), (93, "y" * 9000)]
    for tokens in (packing.SHARD_TOKENS, 20_000):
        rows = packing.pack(docs_of(docs), shard_tokens=tokens, with_ids=True).collect()
        short, shards = check(rows, docs, 2048)
        assert short <= shards
    assert packing.pack(docs_of([])).count() == 0


def test_neighbours_share_words(docs_of):
    topics = [[f"{t}{i}" for i in range(40)] for t in ("river", "engine", "violin", "glacier")]
    rnd = random.Random(9)
    docs = [(k, " ".join(rnd.choice(topics[k % 4]) for _ in range(100))) for k in range(80)]
    rows = packing.pack(docs_of(docs)).collect()
    together = {}
    for r in rows:
        together.setdefault(r.sequence_id, []).append(r.doc_id % 4)
    alike = sum(max(map(x.count, set(x))) for x in together.values()) / len(rows)
    assert alike > 0.75


def test_neighbours_of_all_shards_sit_together(docs_of):
    rnd = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lt", "rn", "sk", "mp")]
    docs = []
    for pair in range(60):
        base = [rnd.choice(vocab) + str(rnd.randrange(10**6)) for _ in range(60)]
        for copy in range(2):
            docs.append((pair * 2 + copy, " ".join(base[:50] + [rnd.choice(vocab) for _ in range(20)])))
    rows = packing.pack(docs_of(docs), shard_tokens=3000, with_ids=True).collect()
    short, shards = check(rows, docs, 2048)
    assert short <= shards and shards > 6
    shard = {r.doc_id: r.sequence_id >> 32 for r in rows}
    assert all(shard[2 * k] == shard[2 * k + 1] for k in range(60))


def test_one_large_group_is_dealt_over_shards(docs_of):
    docs = [(k, "the same text in every copy of it " * 20) for k in range(200)]
    rows = packing.pack(docs_of(docs), shard_tokens=3000, with_ids=True).collect()
    short, shards = check(rows, docs, 2048)
    assert short <= shards and shards > 5


def test_further_terms_are_asked_while_none_is_found():
    # the first document's 60 rarest ids are its own, the next ones stand in used documents only
    docs = [np.concatenate((np.arange(100, 160), np.arange(20), [50])), np.arange(20), np.array([50, 51])]
    idf = np.ones(200, np.float32)
    idf[100:160], idf[:20] = 3, 2
    index = packing.Index(docs, idf, 30.0)
    assert index.neighbours(0, np.array([True, True, False])) == [2]
    assert index.neighbours(0, np.array([True, False, False])) == [1]


def test_ids_meet_their_shard_without_a_shuffle(spark):
    rows = [(k % 30, f"text {k % 30} of a document") for k in range(60)]  # every row twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = packing.tokens(docs).withColumn("key", F.xxhash64("doc_id", "text_hash"))
    made = packing.written_where_made(made)
    dealt = packing.deal(made, spark.createDataFrame([], "key long, best long"), 3, 10**6)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    ids = plan.index("ids#", plan.index("FileScan"))
    assert "Exchange" not in plan[:ids]  # the scan of the ids comes first, below the join alone
    got = sorted((r.doc_id, r.n) for r in dealt.collect())
    assert got == sorted((r.doc_id, r.n) for r in made.collect()) and len(got) == 60


def test_chunks_are_remembered_in_two_turns(monkeypatch):
    encoder = packing.Encoder(packing.default_path())
    calls = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda chunks: calls.append(sorted(chunks)) or learn(chunks))
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    texts = ["it alpha beta gamma delta", "it alpha zeta", "it alpha, beta \u00e9t\u00e9 x9"]
    for t in texts + texts:
        assert encoder.encode([t])[0].tolist() == reference_ids([t])[0]
    # what was met a turn ago is not learned again, as it was when all was forgotten at once
    assert calls[1] == ["zeta"] and "alpha" not in calls[2]
    assert sum("alpha" in c for c in calls) == 1
    # words of letters take the merges alone, others the whole tokenizer
    words = ["Alpha", "zZzq", "don", "t", "caf\u00e9", "x9", "a_b", "don't", "--", "1234"]
    alone = encoder._learn(words)
    assert [np.frombuffer(alone[w], encoder.width).tolist() for w in words] == reference_ids([" " + w for w in words])


def test_letter_words_take_the_model_and_plain_texts_no_second_look(monkeypatch):
    rnd = random.Random(21)
    latin = [chr(k) for k in range(0xC0, 0x250)] + list("abcdefghij" * 30)
    texts = [" ".join("".join(c for c in rnd.choices(latin, k=rnd.randrange(1, 12)) if c.isalpha()) or "x"
                      for _ in range(200)) for _ in range(5)]
    encoder = packing.Encoder(packing.default_path())
    together, looked = [], []
    plainly, odd = encoder._together, encoder._odd
    monkeypatch.setattr(encoder, "_together", lambda words, *a, **k: together.extend(words) or plainly(words, *a, **k))
    monkeypatch.setattr(encoder, "_odd", lambda text: looked.append(text) or odd(text))
    texts += ["caf\u00e9 \u0141\u00f3d\u017a, x9 it. End.\nNew line"]
    assert [x.tolist() for x in encoder.encode(texts)] == reference_ids(texts)
    assert not any(w.isalpha() for w in together if w not in ("New", "line")) and "x9" in together
    assert not looked


def test_every_odd_text_is_looked_at():
    rnd = random.Random(22)
    marks = [*packing.ODD, " ", "\n", ". ", ", ", ".\n", ",\n", "a", "\u00e9", "\u6f22", "7", "_", "\u0663", "-", "\u02b0"]
    texts = ["".join(rnd.choices(marks, k=rnd.randrange(5))) for _ in range(20_000)]
    texts += [a + b + c + "z" for a in marks for b in ".," for c in " \n"]
    maybe = pc.match_substring_regex(pa.array(texts, pa.large_string()), packing.MAYBE_ODD).to_pylist()
    assert all(m for t, m in zip(texts, maybe) if packing.Encoder._odd(t))
    assert not any(m for t, m in zip(["a b", "a, b. c", "9. x", "\u00e9, e\nf"], pc.match_substring_regex(
        pa.array(["a b", "a, b. c", "9. x", "\u00e9, e\nf"]), packing.MAYBE_ODD).to_pylist()))


def test_postings_of_a_shard_sorted_once(monkeypatch):
    rnd = np.random.default_rng(3)
    docs = [rnd.integers(0, 300, n).astype("<u2") for n in (1, 5, 400, 2000, 3)]
    idf = rnd.choice(np.array([0.5, 1, 1.5, 2], np.float32), 300)
    want = []
    for k, x in enumerate(docs):
        for t, tf in zip(*np.unique(x, return_counts=True)):
            norm = packing.K1 * (1 - packing.B + packing.B * len(x) / 500.0)
            want.append((t, k, np.float32(idf[t] * tf * (packing.K1 + 1) / (tf + norm))))
    monkeypatch.setattr(np, "unique", None)  # no document is sorted on its own
    index = packing.Index(docs, idf, 500.0)
    at = np.repeat(np.arange(300), np.diff(np.concatenate(([0], index.ends))))
    assert list(zip(at, index.place, index.weight)) == sorted(want)
