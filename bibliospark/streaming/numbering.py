"""Messages numbered as they arrive (K4, W3): the position of each message in its
user's history without reading the log.

``readStream`` (files of messages) -> ``transformWithState`` per user ->
``writeStream`` (parquet, exactly once). A user's state is the number of messages
so far and every id, packed by ranges of ``SPAN`` ids: a micro-batch asks for and
renews a range once, not each id, and a range is at most 128 KB however long the
history. Messages of one micro-batch are numbered by
(created_at, id) behind the earlier ones, so a stream whose batches follow the
order of the log gives the numbers of ``messages.numbered``; a message that comes
late gets the next number, since numbers that were given do not change.

A message that lands again - a replayed file, a repeated id within a batch - is
known by its id and changes nothing. State and progress lie in the stream's
checkpoint in the shared folder, in RocksDB, so state is bound by the disk; a task
holds one user's rows of one micro-batch, which ``max_files_per_trigger`` bounds.
Null user ids are a user of their own; a message without an id is numbered and
never taken for a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.messages import MESSAGE_SCHEMA
from ..session import scratch_path

NUMBERED_SCHEMA = f"{MESSAGE_SCHEMA}, message_no long"
_STATE = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Ids of one range of a user's state, each two bytes in it.
SPAN = 1 << 16
_NUMBERED = Row("id", "user_id", "question", "response", "created_at", "message_no")


class Numbering(StatefulProcessor):
    """Counter and seen ids of one user."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.seen = handle.getMapState("seen", "range long", "ids binary")
        self.pick = None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = before = (self.count.get() or (0,))[0]
        order = sorted(map(self._values, rows), key=lambda r: (r[4] is not None, r[4] or 0, r[0] is not None, r[0] or 0))
        held: dict[int, set[int]] = {}  # the ranges this batch touches
        fresh: set[int] = set()
        for r in order:
            if r[0] is not None:
                part, place = divmod(r[0], SPAN)
                if part not in held:
                    held[part] = set(self._ids(part).tolist())
                if place in held[part]:
                    continue
                held[part].add(place)
                fresh.add(part)
            n += 1
            yield _NUMBERED(*r, n)
        for part in fresh:
            self.seen.updateValue((part,), (np.array(list(held[part]), "<u2").tobytes(),))
        if n != before:
            self.count.update((n,))

    def _values(self, row: Row) -> tuple:
        """The row as a plain tuple in the order of ``MESSAGE_SCHEMA``; names are looked up once."""
        if self.pick is None:
            self.pick = itemgetter(*[row.__fields__.index(c) for c in _NUMBERED[:-1]])
        return self.pick(row)

    def _ids(self, part: int) -> np.ndarray:
        """The ids of a range, from its start."""
        got = self.seen.getValue((part,))
        return np.frombuffer(bytes(got[0]) if got else b"", "<u2")

    def close(self) -> None:
        pass


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    """Settings a stream takes on when it starts; the session keeps its own."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def number_stream(messages: DataFrame) -> DataFrame:
    """The streaming ``messages`` with ``message_no``, each id once. Times pass
    through Python as microseconds, which costs a fraction of a datetime."""
    numbered = messages.withColumn("created_at", F.unix_micros("created_at")).groupBy("user_id").transformWithState(
        Numbering(), outputStructType=NUMBERED_SCHEMA.replace("timestamp", "long"), outputMode="Append", timeMode="None")
    return numbered.withColumn("created_at", F.timestamp_micros("created_at"))


def start(spark: SparkSession, source_dir: str, out_dir: str, *, max_files_per_trigger: int = 16,
          state_partitions: int | None = None, checkpoint_location: str | None = None, available_now: bool = False):
    """Start the stream; returns the ``StreamingQuery``. ``state_partitions`` is
    fixed by the first start (the session's shuffle partitions by default). The
    numbered log is :func:`numbered_log`."""
    stream = (spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    conf = dict(_STATE)
    if state_partitions:
        conf["spark.sql.shuffle.partitions"] = str(state_partitions)
    with _settings(spark, conf):
        writer = (number_stream(stream).writeStream.outputMode("append").format("parquet").option("path", out_dir)
                  .option("checkpointLocation", checkpoint_location or scratch_path(spark, "numbering-stream")))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")
        return writer.start()


def numbered_log(spark: SparkSession, out_dir: str) -> DataFrame:
    """What the stream has written so far."""
    return spark.read.schema(NUMBERED_SCHEMA).parquet(out_dir)
