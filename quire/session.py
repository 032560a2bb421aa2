"""Session settings, and places where a plan's lineage may be cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "quire") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset, and only on a local master, a temporary folder is set.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM is gone already
        pass


def scratch(spark: SparkSession, suffix: str) -> str:
    """A new path in the shared folder for files that are written and read again; deleted when the driver ends."""
    at = f"{shared_folder(spark).rstrip('/')}/quire-{uuid.uuid4().hex}.{suffix}"
    atexit.register(_remove, spark, at)
    return at


def drop(kept: DataFrame) -> None:
    """Deletes a table that :func:`cut` gave and that nothing will read any more; loops keep two this way."""
    if at := getattr(kept, "_kept_at", None):
        _remove(kept.sparkSession, at)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs nothing.

    A Parquet table rather than an RDD checkpoint: columns stay pruned and compressed. It is deleted
    when the driver ends; a driver that is killed leaves it.
    """
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    df.write.parquet(at)
    atexit.register(_remove, spark, at)
    kept = spark.read.schema(df.schema).parquet(at)
    kept._kept_at = at
    return kept


#: Set while a part is computed: its shuffle files go as soon as it is written, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lean(parts: DataFrame | Iterable[DataFrame]) -> DataFrame:
    """As :func:`cut`, for plans with large shuffles: several ``parts`` of the same columns are computed one after the
    other into one table, and the shuffle files of each are removed before the next is begun."""
    kept = at = None
    for df in [parts] if isinstance(parts, DataFrame) else parts:
        spark = df.sparkSession
        if not at:
            kept, at = df, scratch(spark, "parts")
        was = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("append").parquet(at)
        finally:
            spark.conf.set(CLEANUP, was)
    kept = kept.sparkSession.read.schema(kept.schema).parquet(at)
    kept._kept_at = at
    return kept
