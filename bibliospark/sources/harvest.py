"""The paged search harvest as a resumable source (S1, L5, U1): a Python data
source over landed response pages whose offsets are page numbers.

A folder holds one file per response, ``page-<number>-<start>-<status>.json``, its
content the body; numbers count the requests from 0. A harvest stops at its first
response that is not 200, so pages behind it are never read, and a stream waits
before a page that has not landed. Numbers, starts and states are in the names:
planning lists the folder and opens nothing, tasks read up to ``PAGES`` pages each.

``read_harvest`` is the batch form, ``stream_harvest`` the stream: a query on it
goes on behind the last page of its checkpoint, whichever process starts it. Both
give (page, start, body); ``entries_of`` the search entries, as
``landed.pages_until_error`` gives them for pages in a table. Files appear whole:
they are written under another name and renamed.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Pages of one task.
PAGES = 64
_NAME = re.compile(r"page-(\d+)-(\d+)-(\d+)\.json$")
SCHEMA = "page long, start long, body string"


def _folder(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _landed(uri: str, page: int = 0) -> list[tuple[int, int, str]]:
    """(number, start, path) of the consecutive good pages from ``page`` on."""
    from pyarrow import fs
    system, base = _folder(uri)
    found = {}
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if name := _NAME.search(f.path):
            found[int(name[1])] = (int(name[2]), int(name[3]), f.path)
    out = []
    while page in found and found[page][1] == 200:
        out.append((page, found[page][0], found[page][2]))
        page += 1
    return out


class Pages(D.InputPartition):
    def __init__(self, pages: list[tuple[int, int, str]]):
        self.pages = pages


def _cut(pages: list) -> list[Pages]:
    return [Pages(pages[k:k + PAGES]) for k in range(0, len(pages), PAGES)]


def _bodies(uri: str, partition: Pages):
    system, _ = _folder(uri)
    for page, start, path in partition.pages:
        with system.open_input_stream(path) as stream:
            yield page, start, stream.read().decode("utf-8")


class HarvestReader(D.DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self):
        return _cut(_landed(self.uri)) or [Pages([])]

    def read(self, partition):
        return _bodies(self.uri, partition)


class HarvestStream(D.DataSourceStreamReader):
    """Offsets are the number of pages read."""

    def __init__(self, uri: str):
        self.uri = uri
        self.end = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        # never before what was seen; a failed page ends the harvest for good
        self.end += len(_landed(self.uri, self.end))
        return {"page": self.end}

    def partitions(self, start: dict, end: dict):
        pages = _landed(self.uri, start["page"])
        return _cut([p for p in pages if p[0] < end["page"]])

    def read(self, partition):
        return _bodies(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class HarvestSource(D.DataSource):
    """``spark.read.format("harvest").option("path", folder URI)``."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return HarvestReader(self.options["path"])

    def streamReader(self, schema):
        return HarvestStream(self.options["path"])


def folder_uri(path: str) -> str:
    """A path as the URI that the source opens."""
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"


def read_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """(page, start, body) of the pages before the first failed or missing one."""
    spark.dataSource.register(HarvestSource)
    return spark.read.format("harvest").option("path", folder_uri(folder)).load()


def stream_harvest(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream, page after page as they land."""
    spark.dataSource.register(HarvestSource)
    return spark.readStream.format("harvest").option("path", folder_uri(folder)).load()


def entries_of(pages: DataFrame) -> DataFrame:
    """(start, pos, entry): the search entries; a page without any adds nothing."""
    entries = F.try_variant_get(F.try_parse_json("body"), "$['search-results']['entry']", "array<variant>")
    return pages.select("start", F.posexplode(entries).alias("pos", "entry"))


def land_pages(pages: DataFrame, folder: str) -> int:
    """Write the responses (page, start, status, body), ``page`` being the number of
    the request, as files of a harvest; a page that landed before is replaced.
    Returns their number."""
    uri = folder_uri(folder)

    def save(batches):
        system, base = _folder(uri)
        system.create_dir(base, recursive=True)
        n = 0
        for b in batches:
            for page, start, status, body in zip(*[c.to_pylist() for c in b.columns]):
                name = f"{base}/page-{page:09d}-{start}-{status}.json"
                with system.open_output_stream(f"{name}.part") as out:
                    out.write((body or "").encode("utf-8"))
                system.move(f"{name}.part", name)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = pages.select("page", "start", "status", "body").mapInArrow(save, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0
