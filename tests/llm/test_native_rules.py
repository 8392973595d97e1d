"""Operators 1 and 8 on edge rows; the whole tables are compared with DuckDB."""

import hashlib
import random
import re

from bibliospark.llm import quality_rules, winnowing


def base_figures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + o for i, g in enumerate(grams) if grams.count(g) > 1 for o in range(3)}
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_base_figures(docs_of):
    texts = [None, "", " \n\t", "one", "a b", "a a a a", "x y z x y z\nx y z\n x y z\n\n#*|<é😀 x y z",
             "a b c d a b c d a b", "l\nl\nl \n", "  no-break\x1c stays"]
    rows = quality_rules.judge(docs_of(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_figures(texts[r.doc_id])
        assert r.base_failed and not r.kept


def clean(n, words=60):
    return " ".join(f"w{n}q{i}" for i in range(words))


def test_boilerplate_depletes_and_clean_documents_stay(docs_of):
    menu = "Home   About\tContact " + " ".join(f"link{i}" for i in range(70))
    rows = [(i, clean(i) + "\n" + clean(i + 1000), "a") for i in range(20)]
    rows += [(100 + i, menu.upper() + f"\nown words of page {i}", "a") for i in range(12)]
    rows += [(200 + i, clean(5000), "a") for i in range(15)]   # exact copies are no boilerplate
    rows += [(300, clean(7000), None), (300, clean(7000), None), (None, clean(8000), "a")]
    docs = docs_of(rows)
    kept = [r.doc_id for r in quality_rules.judge(docs).where("kept").collect()]
    assert sorted(k for k in kept if k is not None) == [*range(20), *range(200, 215), 300, 300] and None in kept
    again = quality_rules.keep_good(docs)
    assert again.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in again.collect()) == sorted(k or 0 for k in kept)
    assert quality_rules.strip_boilerplate(docs).count() == 12
    assert quality_rules.judge(docs.where("false")).count() == 0
    assert quality_rules.keep_good(docs.where("false")).count() == 0


def brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, got = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(10, len(v))
        wins = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i:i + n]) in wins:
                hit |= set(range(i, i + n))
                got.add(item_id)
    ids = sorted(str(g) for g in got if g is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_windows_against_brute_force(spark, docs_of):
    rnd = random.Random(3)
    few = [f"t{i}" for i in range(4)]
    items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.choice((10, 11, 14, 30))))) for i in range(12)]
    items += [(50, "Rare-Pair!"), (51, "solo"), (52, ""), (53, None), (None, "no id here at all"), (54, "solo"),
              (55, "née Ünïc word three four five six seven eight"), (9, "t0 t1")]
    docs = [(i, " ".join(rnd.choice(few) for _ in range(rnd.choice((3, 9, 10, 40, 200))))) for i in range(40)]
    for i in range(40, 80):
        src = items[rnd.randrange(12)][1].split()
        a = rnd.randrange(len(src) - 8)
        docs.append((i, " ".join([f"u{i}"] * 7 + src[a:a + rnd.choice((9, 10, 12))] + ["z"] * 6).title()))
    docs += [(90, None), (91, ""), (92, "a solo, rare... PAIR no id here at all"), (92, "other text"),
             (92, "a solo, rare... PAIR no id here at all"), (93, "NéE Ünïc word three four five six seven eight")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as words", "1 as hash")
    got = sorted(tuple(r) for r in winnowing.judge(docs_of(docs), bench).collect())
    assert got == sorted((d, *brute_hits(t, items)) for d, t in docs)
    kept = winnowing.drop_contaminated(docs_of(docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t in docs if not brute_hits(t, items)[4])
    none = winnowing.judge(docs_of(docs), bench.where("false")).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert winnowing.judge(docs_of([]), bench).count() == 0


def test_shuffled_join_gives_the_same(spark, docs_of, monkeypatch):
    items = [(1, " ".join(f"k{i}" for i in range(25)))]
    docs = docs_of([(1, "x " + items[0][1][:60]), (2, items[0][1]), (3, "nothing")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = sorted(map(tuple, winnowing.judge(docs, bench).collect()))
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, winnowing.judge(docs, bench).collect())) == a


def test_quality_stage_drops_boilerplate_lines(spark, docs_of):
    import corpus_pipeline
    rows = [(i, f"Home  About\n{clean(i)}\n\nhome about\n  {clean(i + 1000)}", "a") for i in range(12)]
    rows += [(100, "Home  About\n" + clean(100), "b"), (101, clean(101), None), (102, rows[0][1], "a"), (102, rows[0][1], "a")]
    rows += [(200 + i, " ".join(f"menu{k}" for k in range(60)) + f"\nown words of {i}", "a") for i in range(10)]
    docs = docs_of(rows)
    out = corpus_pipeline.quality(spark, docs, None)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect())
    want = [(d, t if s != "a" else t.replace("Home  About\n", "").replace("home about\n", "")) for d, t, s in rows if d < 200]
    assert got == sorted(want)
    assert all(r.n_chars in (None, len(r.text)) for r in out.collect())
    assert sorted(r.doc_id for r in quality_rules.keep_good(docs).collect()) == [d for d, _ in got]
