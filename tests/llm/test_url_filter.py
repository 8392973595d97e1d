import itertools
import math
import random

from bibliospark.llm import url_filter

WORDS = ["news", "sport", "casino", "win", "garden", "river", "cheap", "the", "book"]


def page_rows(urls, html="<p class='casinowin'>" + " ".join(WORDS * 20) + "</p>"):
    return [(i, u, html, "x") for i, u in enumerate(urls)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://WWW.Example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://m.example.com/en/x?q#f": ("m.example.com", "/en/x", "example.com/en/", "block"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "https://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
        "https://x.net/fr/": ("x.net", "/fr/", "net/fr/", "block"),
        "com/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "http://x.com": ("x.com", "", None, None), "http://x.com?a/b": ("x.com", "", None, None),
        "http://x.com#y://z.net/fr/": ("x.com", "", None, None), "a://b://c.com/": ("b:", "//c.com/", None, None),
        "http://": ("", "", None, None), "http://É.COM/a": ("É.com", "/a", "com/", "allow"),
    }
    urls = list(cases)
    got = {urls[r.page_id]: r for r in url_filter.judge(frame(spark, page_rows(urls))).collect()}
    assert len(got) == len(urls)
    for u, (host, path, rule, verdict) in cases.items():
        r = got[u]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.block_score is None) == (rule is not None)


def test_segmentation_is_the_best_split():
    rnd = random.Random(2)
    words = {w: math.log(rnd.random()) for w in ("a", "ab", "abc", "ba", "c", "ca", "b")}
    s = url_filter.Segmenter(words)
    for _ in range(200):
        name = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))
        def score(parts):
            return sum(words.get(p, s.unknown - 3.0 * len(p)) for p in parts)
        splits = []
        for cuts in itertools.product((0, 1), repeat=len(name) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(name[last:i])
                    last = i
            splits.append(parts + [name[last:]])
        assert math.isclose(score(s.split(name)), max(map(score, splits)))
    assert s.split("") == []


def test_learned_verdicts_on_held_out_hosts(spark):
    rnd = random.Random(3)
    urls = []
    for i in range(400):
        good = "".join(rnd.sample(["garden", "river", "book", "news"], 2))
        bad = "".join(rnd.sample(["casino", "win", "cheap"], 2))
        urls += [f"http://{good}.com/en/{i}", f"http://{bad}.net/es/{i}"]
    held = [(f"http://{''.join(rnd.sample(['garden', 'river', 'book', 'news'], 3))}.org/x/{i}", "allow") for i in range(60)]
    held += [(f"http://{''.join(rnd.sample(['casino', 'win', 'cheap'], 3))}.org/x/{i}", "block") for i in range(60)]
    rows = page_rows(urls + [u for u, _ in held])
    got = {r.page_id: r.verdict for r in url_filter.judge(frame(spark, rows)).collect()}
    right = sum(got[len(urls) + k] == v for k, (_, v) in enumerate(held))
    assert right >= 0.95 * len(held)


def test_one_class_none_and_edge_rows(spark):
    long = "http://" + "gardencasino" * 300 + ".org/" + "a/" * 2000
    assert {r.verdict for r in url_filter.judge(frame(spark, page_rows(["http://a.org/", None, long]))).collect()} == {"allow"}
    only_block = url_filter.judge(frame(spark, page_rows(["http://a.net/es/", "http://b.org/"]))).collect()
    assert {r.verdict for r in only_block} == {"block"}
    assert url_filter.judge(frame(spark, [])).count() == 0
    twice = url_filter.judge(frame(spark, [(None, "http://x.org/", None, None)] * 2 + page_rows(["http://x.com/"]))).collect()
    assert len(twice) == 3 and {r.verdict for r in twice} == {"allow"}


def test_most_frequent_takes_whole_classes_within_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1] * 20 + [2] * 5 + [90, 91, 3000])], "word string, n long")
    for size, want in ((100, 28), (28, 28), (27, 8), (8, 8), (7, 3), (2, 2), (1, 1), (0, 0)):
        rows = url_filter.most_frequent(counts, size)
        assert len(rows) == want and len(rows) <= max(size, 0)
        assert sorted((r.n for r in rows), reverse=True) == sorted([1] * 20 + [2] * 5 + [90, 91, 3000], reverse=True)[:want]
    assert url_filter.most_frequent(counts.where("false"), 5) == []


def test_counts_beyond_what_tasks_hold_are_looked_up(spark, monkeypatch):
    rnd = random.Random(5)
    urls = []
    for i in range(60):
        good, bad = (rnd.sample(x, 2) for x in (["garden", "river", "book", "news"], ["casino", "win", "cheap"]))
        urls += [f"http://{''.join(good)}.com/en/{i}", f"http://{''.join(bad)}.net/es/once{i}",
                 f"http://{''.join(good + bad)}{'x' * (i % 2)}.org/once{i}/{good[0]}", f"http://{bad[0]}{good[0]}.org/en/"]
    rows = frame(spark, page_rows(urls + urls[:30] + [None, "http://a1-b.org/é"]))
    want = sorted(map(tuple, url_filter.judge(rows).collect()))
    whole = url_filter.most_frequent
    for held in (3, 0):
        monkeypatch.setattr(url_filter, "most_frequent", lambda counts, size: whole(counts, held))
        assert sorted(map(tuple, url_filter.judge(rows).collect())) == want
