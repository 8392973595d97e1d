import hashlib
import io

from pyspark.sql import functions as F

from bibliospark.llm import warc
from bibliospark.session import scratch_path


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows],
                                 "page_id long, url string, html string, payload_digest string, first long")


ROWS = [(1, "http://a/", "p" * 1000), (5, "http://b/", "p" * 1000), (3, None, "p" * 1000), (2, "http://c/", "p" * 999),
        (4, "http://c/", "p" * 999), (6, "u\r\nWARC-Type: forged%0A", None), (7, "", ""), (8, "http://é/", "é\r\n\r\nü" * 400),
        (9, "http://twice/", "q" * 2000), (9, "http://twice/", "q" * 2000), (None, "no id", "p" * 1000), (-4, "n", "z" * 70_000)]


def expected(rows):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same) if len(raw) >= 1000 and same else page
        revisit = len(raw) >= 1000 and page != first
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response",
                    first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = warc.query(spark, pages_of(spark, ROWS))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS)
    assert warc.query(spark, pages_of(spark, ROWS[:0])).count() == 0


def test_payloads_urls_and_pushed_predicates(spark):
    folder = scratch_path(spark, "warc")
    warc.write(pages_of(spark, ROWS), folder)
    records = warc.read(spark, folder)
    rows = records.collect()
    assert len(rows) == len(ROWS)
    assert {r.target_uri for r in rows} == {u for _, u, _ in ROWS}
    by_id = {r.record_id: r for r in rows}
    assert by_id["<urn:page:8>"].payload.decode() == ROWS[7][2] and by_id["<urn:page:-4>"].payload == b"z" * 70_000
    some = records.where((F.col("record_type") == "response") & (F.col("payload_bytes") > 999) & F.col("target_uri").isNotNull())
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan and "+- Filter" not in plan
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:-4>", "<urn:page:5>", "<urn:page:8>"] + ["<urn:page:9>"] * 2
    assert records.where(F.col("target_uri").contains("twice")).count() == 2  # not pushed, still right
    assert all(r.payload is None for r in warc.read(spark, folder, payload=False).collect())


def test_skipped_payloads_are_not_read():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out
    import os
    data = b"".join(warc.member([("WARC-Type", t), ("WARC-Payload-Digest", "sha1:x")], os.urandom(900_000))
                    for t in ("response", "other", "response", "other"))
    stream = Counting(data)
    got = list(warc.records(stream, lambda h: h["record_type"] == "none", True))
    assert got == [] and stream.taken < len(data) / 5
    assert [h["length"] for h, _ in warc.records(io.BytesIO(data), lambda h: True, True)] == [900_000] * 4


def test_other_archives(tmp_path, spark):
    """Plain records, and gzip members without their length; not our writer's."""
    import gzip
    heads = [[("WARC-Type", "warcinfo")], [("warc-type", "resource"), ("WARC-Target-URI", "http://r/")],
             [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]]
    blocks = [b"software: x\r\n", b"p" * 200_000, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore"]
    want = [("warcinfo", blocks[0]), ("resource", blocks[1]), ("response", b"body\r\n\r\nmore")]
    plain = [warc.plain(h, b) for h, b in zip(heads, blocks)]
    for data in (b"".join(plain), b"".join(map(gzip.compress, plain)),
                 gzip.compress(plain[0]) + warc.member(heads[1], blocks[1]) + plain[2]):
        got = [(h["record_type"], p) for h, p in warc.records(io.BytesIO(data), lambda h: True, True)]
        assert got == want
        some = list(warc.records(io.BytesIO(data), lambda h: h["record_type"] == "response", True))
        assert [p for _, p in some] == [want[2][1]]
    (tmp_path / "a.warc").write_bytes(b"".join(plain))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, plain)))
    rows = warc.read(spark, f"file://{tmp_path}").where("record_type <> 'warcinfo'").collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == sorted(want[1:] * 2)
    import pytest
    for cut in (plain[1][:5000], gzip.compress(plain[1])[:100], b"no archive at all, only some text"):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(cut), lambda h: True, True))
