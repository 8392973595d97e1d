"""Dense row numbering that never routes a whole group through one task.

``row_number().over(Window.partitionBy(key).orderBy(...))`` sends every row of
a key to one task, so a key holding a third of the data becomes a third of the
job in a single task; without a key it is a single-partition window. Here the
rows are instead range-partitioned on ``(key, order...)`` (the sampled bounds
split a hot key over many tasks), numbered locally, and shifted by the row
counts of the earlier partitions of the same key. Only per-(partition, key)
counts are aggregated - at most ``partitions`` rows for a hot key.

The tagged, sorted rows are written to a compressed table in the shared
``spark.checkpoint.dir`` (or a reliable checkpoint, which goes with its
DataFrame) so partition ids and local positions are fixed and survive executor
loss. A row may stand for several (``weight``): it gets the number of the first
of them, so rows need not be repeated to be numbered. The counts come back by broadcast while their number is
under ``BROADCAST_ROWS`` and their keys under ``BROADCAST_KEYS`` (both counted),
which keeps the rows in order and unmoved, and by a shuffle join beyond it. A NULL
key is a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, never_broadcast, written

#: (partition, key) counts that may be broadcast: about 40 bytes each beside the key.
BROADCAST_ROWS = 500_000
#: Characters of their keys, which the broadcast holds several times.
BROADCAST_KEYS = 4_000_000


def sequence_numbers(df: DataFrame, order_cols: list, key: str | None = None,
                     out: str = "seq", start: int = 1, weight: str | None = None, table: bool = True) -> DataFrame:
    """Add ``out``: 1-based (or ``start``-based) position of each row in
    ``order_cols`` order, restarting per ``key`` when given. ``order_cols``
    must make the order total (end with a unique column). With ``weight`` a row
    counts as so many. ``table``: the rows stay in a compressed table; without
    it in a checkpoint that is removed with its DataFrame."""
    ensure_checkpoint_dir(df.sparkSession)
    sort_keys: list[Column] = ([F.col(key)] if key else []) + [
        F.col(c) if isinstance(c, str) else c for c in order_cols]
    tagged = (df.orderBy(*sort_keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = written(tagged, "numbered") if table else tagged.checkpoint()
    grp = ["_pid"] + ([key] if key else [])
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    stats = tagged.groupBy(*grp).agg(rows.alias("_n"), F.min("_mid").alias("_m0"))
    # offsets: rows of the same key in earlier partitions. A key spans at most
    # as many stats rows as there are partitions.
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(F.col("_pid").alias("_p"), *([F.col(key).alias("_k")] if key else []), "_m0",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    offsets = F.broadcast(offsets) if not key or _few(stats, key) else never_broadcast(offsets)
    local = F.col("_mid") - F.col("_m0")
    if weight:  # the weights of the key's earlier rows in the partition
        here = Window.partitionBy(*grp).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        tagged = tagged.withColumn("_at", F.coalesce(F.sum(weight).over(here), F.lit(0)))
        local = F.col("_at")
    met = F.col("_pid") == F.col("_p")
    if key:
        met = met & F.col(key).eqNullSafe(F.col("_k"))
    return (tagged.join(offsets, met)
            .withColumn(out, (F.col("_off") + local + F.lit(start)).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off", "_p", "_k", "_at"))


def _few(stats: DataFrame, key: str) -> bool:
    """Whether the counts per (partition, key) are small enough to be broadcast."""
    n, chars = stats.agg(F.count(F.lit(1)), F.sum(F.length(F.col(key).cast("string")))).first()
    return n <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_KEYS
