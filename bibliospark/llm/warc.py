"""Operator 5, WARC: a PySpark Python data source and its writer.

`spark.read.format("warc")` reads archives (`.warc`, and `.warc.gz` with a gzip
member per record) from any file system that pyarrow opens by URI. Partitions
are planned from the files' sizes. Of every record the header is read and
parsed first; predicates on the header columns (equality, membership,
comparison, prefixes and null tests on record_type, record_id, refers_to,
target_uri, payload_digest, payload_bytes) are pushed into the reader. The
payload is decoded only for records that pass, and only if asked for (option
`payload`). Records that are not wanted are passed over: by their Content-Length
in plain archives, by the member's length in gzip archives whose members carry
it (extra field `sl`, as the writer's do); other members are inflated to their
end without being kept. The payload of an HTTP response record is its body.

The writer makes a record per page: of pages with equal payloads of at least
1000 bytes that with the largest page_id is the response, the others revisit
it. A task writes files of its own under a fresh name and reports them when
they are closed; only reported files are read, so a retried task leaves no
record twice.

Plan: payloads of a digest are counted by a pre-aggregated shuffle of digests;
only digests that occur again join back, read from a written table, so a hot
payload's partition can be split. Html never shuffles.

Defined cases: null html is an empty payload; a null url is an absent
header, a null page_id a record named by a UUID; of rows that share the largest page_id each is a response; equal rows
give a record each. Equal payloads are known by SHA-1 and length. Line breaks in
a url are written percent-encoded, so a url cannot forge a header.
"""

from __future__ import annotations

import datetime
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import materialise, small_batches

MIN_REVISIT = 1000
#: Bytes of one archive, and of one read partition.
ARCHIVE_BYTES = 256 << 20
PARTITION_BYTES = 128 << 20

SCHEMA = ("record_type string, record_id string, refers_to string, target_uri string, "
          "payload_digest string, payload_bytes long, payload binary")
#: The named fields behind the columns.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To",
          "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest",
          "payload_bytes": "X-Payload-Bytes"}
_ID = "urn:page:"
#: Fixed value: the response head before each payload; pages come without their own.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


# --- records -----------------------------------------------------------------

def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member whose `sl` field holds its length and the record's."""
    record = plain(headers, block)
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 14 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def plain(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as it stands in an archive that is not compressed."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _escaped(url: str) -> str:
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(url: str) -> str:
    return url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _header(head: bytes) -> dict:
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    out = {c: fields.get(name.lower()) for c, name in FIELDS.items()}
    out["payload_bytes"] = int(out["payload_bytes"]) if out["payload_bytes"] else None
    out["length"] = int(fields["content-length"])
    out["http"] = fields.get("content-type", "").startswith("application/http")
    if out["target_uri"] is not None:
        out["target_uri"] = _unescaped(out["target_uri"])
    return out


class _Input:
    """A stream that can look ahead, skip, and take bytes back."""

    STEP = 1 << 16

    def __init__(self, stream):
        self.stream, self.held, self.at = stream, b"", 0

    def look(self, n: int) -> bytes:
        """The next n bytes, or what is left, without passing them."""
        while len(self.held) - self.at < n:
            more = self.stream.read(max(self.STEP, n))
            if not more:
                break
            self.held, self.at = self.held[self.at:] + more, 0
        return self.held[self.at:self.at + n]

    def take(self, n: int) -> bytes:
        out = self.look(n)
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held[self.at:], 0

    def skip(self, n: int) -> None:
        left = len(self.held) - self.at
        if n > left:
            self.stream.seek(n - left, 1)
            self.held, self.at = b"", 0
        else:
            self.at += n


def _take(read):
    """A record's header, from ``read()`` giving the record's bytes in order; a
    function that returns its block; and the bytes read beyond the header."""
    text = b""
    while b"\r\n\r\n" not in text:
        more = read()
        if not more:
            raise ValueError("archive ends within a record")
        text += more
    head, _, rest = text.partition(b"\r\n\r\n")
    header = _header(head)

    def block():
        parts, left = [rest], header["length"] - len(rest)
        while left > 0:
            more = read()
            if not more:
                raise ValueError("record shorter than its Content-Length")
            parts.append(more)
            left -= len(more)
        return b"".join(parts)[:header["length"]]

    return header, block, rest


def _payload(header: dict, block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if header["http"] else block


def records(stream, wanted, payload: bool):
    """(header, payload or None) of the records of an open archive that pass ``wanted``."""
    source = _Input(stream)
    while start := source.look(24):
        if start[:2] == b"\x1f\x8b":
            inflate, taken = zlib.decompressobj(31), 0

            def read():
                nonlocal taken
                while not inflate.eof:
                    step = source.take(4096)
                    taken += len(step)
                    text = inflate.decompress(step)
                    if text or not step:
                        return text
                return b""

            header, block, _ = _take(read)
            if wanted(header):
                yield header, _payload(header, block()) if payload else None
            if start[3] & 4 and start[12:14] == b"sl":
                size = struct.unpack_from("<I", start, 16)[0]
                if taken <= size:
                    source.skip(size - taken)
                else:
                    source.back(inflate.unused_data)
            else:  # the member's end is where it inflates to
                while not inflate.eof:
                    if not read() and not inflate.eof:
                        raise ValueError("archive ends within a record")
                source.back(inflate.unused_data)
        elif start[:5] == b"WARC/":
            taken = 0

            def read():
                nonlocal taken
                step = source.take(4096)
                taken += len(step)
                return step

            header, block, rest = _take(read)
            end = taken - len(rest) + header["length"] + 4
            if wanted(header):
                yield header, _payload(header, block()) if payload else None
            if taken <= end:
                source.skip(end - taken)
            else:
                source.at -= taken - end  # the last step is still held
        else:
            raise ValueError("not a WARC record")


# --- data source ---------------------------------------------------------------

_TESTS = {
    D.EqualTo: lambda x, v: x is not None and x == v,
    D.EqualNullSafe: lambda x, v: x == v,
    D.In: lambda x, v: x is not None and x in v,
    D.GreaterThan: lambda x, v: x is not None and x > v,
    D.GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    D.LessThan: lambda x, v: x is not None and x < v,
    D.LessThanOrEqual: lambda x, v: x is not None and x <= v,
    D.IsNull: lambda x, v: x is None,
    D.IsNotNull: lambda x, v: x is not None,
    D.StringStartsWith: lambda x, v: x is not None and x.startswith(v),
}


class WarcSource(D.DataSource):
    """Options: paths (a directory, or JSON list of archive URIs), payload (false: null payloads)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


class Archives(D.InputPartition):
    def __init__(self, paths):
        self.paths = paths


class WarcReader(D.DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.tests = []  # (column, class name, value)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in FIELDS:
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _files(self):
        import json
        paths = self.options["paths"]
        if paths.startswith("["):
            return json.loads(paths)
        from pyarrow import fs
        system, path = _open(paths)
        scheme = paths.split(":", 1)[0] + "://" if "://" in paths else ""
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return [[scheme + f.path, f.size] for f in found if f.path.endswith((".warc", ".warc.gz"))]

    def partitions(self):
        out, held, size = [], [], 0
        for path, n in sorted(self._files()):
            if held and size + n > PARTITION_BYTES:
                out.append(Archives(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Archives(held)] if held or not out else out

    def read(self, partition):
        by_name = {k.__name__: v for k, v in _TESTS.items()}
        tests = [(c, by_name[k], v) for c, k, v in self.tests]
        payload = self.options.get("payload", "true").lower() == "true"

        def wanted(header):
            return all(test(header[c], v) for c, test, v in tests)

        for path in partition.paths:
            system, name = _open(path)
            with system.open_input_file(name) as stream:
                for h, block in records(stream, wanted, payload):
                    yield (*[h[c] for c in FIELDS], block)


def read(spark: SparkSession, paths: list | str, payload: bool = True) -> DataFrame:
    """The records of archives: a folder URI, or [URI, bytes] pairs."""
    import json
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return (spark.read.format("warc").option("paths", paths if isinstance(paths, str) else json.dumps(paths))
            .option("payload", str(payload).lower()).load())


# --- writer ---------------------------------------------------------------------

def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html as bytes, payload_digest, payload_bytes, and first: the
    page_id of the response of a payload that occurs again, else null."""
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"),
                        F.sha1(html).alias("payload_digest"), F.length(html).cast("long").alias("payload_bytes"))
    again = (rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes")
             .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return rows.join(materialise(again, "payloads"), ["payload_digest", "payload_bytes"], "left")


def write(pages: DataFrame, folder: str) -> list:
    """Write a record per row below ``folder``; [URI, bytes] of the archives, a
    few per task."""
    def save(batches):
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, stream, size, name, done = [], None, 0, None, []

        def close():
            nonlocal stream
            if stream is not None:
                stream.close()
                done.append((f"{folder.rstrip('/')}/{name}", size))
                stream = None

        for b in batches:
            for page, url, html, digest, n, first in zip(*[c.to_pylist() for c in b.columns]):
                revisit = first is not None and page != first
                headers = [("WARC-Type", "revisit" if revisit else "response")]
                name_of = f"{_ID}{page}" if page is not None else f"urn:uuid:{uuid.uuid4()}"
                headers += [("WARC-Record-ID", f"<{name_of}>"), ("WARC-Date", date),
                            ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    headers.append(("WARC-Refers-To", f"<{_ID}{first}>"))
                    headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                if url is not None:
                    headers.append(("WARC-Target-URI", _escaped(url)))
                headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", str(n))]
                data = member(headers, HTTP if revisit else HTTP + html)
                if stream is None or size + len(data) > ARCHIVE_BYTES:
                    close()
                    name, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    stream = system.open_output_stream(f"{base.rstrip('/')}/{name}", compression=None)
                stream.write(data)
                size += len(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([s for _, s in done], pa.int64())],
                                             ["path", "size"])

    small_batches(pages.sparkSession)
    date = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = planned(pages).select("page_id", "url", "html", "payload_digest", "payload_bytes", "first")
    return [list(r) for r in rows.mapInArrow(save, "path string, size long").collect()]  # a few names per task


def _page(column: str):
    return F.regexp_extract(column, f"<{_ID}(-?[0-9]+)>$", 1).try_cast("long")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives of ``pages`` into the shared folder and read them back:
    responses with their payloads, whose digest and length are taken anew;
    revisits by their headers alone."""
    paths = write(pages, scratch_path(spark, "warc"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = read(spark, paths).where(F.col("record_type") == "response")
    responses = found.select(
        _page("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    headers = read(spark, paths, payload=False).where(F.col("record_type") == "revisit")
    revisits = headers.select(
        _page("record_id").alias("page_id"), "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        _page("refers_to").alias("refers_to"))
    return responses.select(*columns).unionByName(revisits.select(*columns))


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
