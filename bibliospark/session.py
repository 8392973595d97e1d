"""SparkSession construction and the few session-level settings the jobs rely on."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job assumes. AQE re-plans joins and coalesces small shuffle
# partitions at runtime; skew-join splitting handles a hot key (e.g. the blank
# author id that every anonymous author collapses to).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a JSON object's repeated key keeps its last value
    "spark.sql.variant.allowDuplicateKeys": "true",
    # checkpoints (hit batches of the question stream, numbering passes) are
    # removed from the shared folder once their DataFrame is gone; a long
    # stream would otherwise keep adding files
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "bibliospark",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster, ``master`` is left to spark-submit; locally it defaults to
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        builder = builder.master("local[*]")
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared, fault-tolerant folder
    and is used as is; without it a cluster session raises, because a folder
    of the driver's own machine is not there for the executors. Only a local
    master (tests, trial runs) falls back to a fresh folder under the system
    temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="bibliospark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Hand this package to Python tasks where they cannot import it: they load
    it by name. Does nothing where the working folder or PYTHONPATH of this
    process, which the workers share, holds it, or where it was handed on."""
    package = os.path.dirname(os.path.abspath(__file__))
    root, sc = os.path.dirname(package), spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in [os.path.abspath(p) for p in known if p] or getattr(sc, "_bibliospark_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="bibliospark-"), "bibliospark"), "zip",
                                  root, os.path.basename(package))
    sc.addPyFile(archive)
    sc._bibliospark_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a compressed table in the shared checkpoint folder
    and read back. A checkpoint holds the same rows uncompressed, so large rows
    are written this way."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """``df`` as a join side that grows with the data: it meets the other side by a
    shuffle. Left alone, Spark broadcasts a side whose files are small, and files
    that are compressed well say little of their rows in the driver's memory."""
    return df.hint("merge")
