"""Incremental flows over files that keep arriving, by Structured Streaming.

What the batch operators do with a whole log, these do as it grows: the last row of a key wins, ids
are taken once within a lateness bound, and a table is kept up to date. Windowed counts are an
extension; the batch side has no such operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.relational import latest, upsert


def arriving(spark: SparkSession, folder: str, schema, files_at_once: int = 100) -> DataFrame:
    """The Parquet files of a folder as they arrive, a bounded number at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def once(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within ``late``; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, by, n): counts of tumbling windows, each given out once it can't change any more."""
    return (
        stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), by, "n")
    )


def sessions(stream: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(by, start, end, n): runs of rows with no longer break than ``gap``."""
    return (
        stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
        .select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def keep_latest(key: str, at: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch's last rows replace the table's rows of the same keys. Every
    batch writes a new version beside the others, so a repeated batch gives the same version."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = latest(batch, key, at)
        if number:
            fresh = upsert(spark.read.parquet(f"{path}/v{number - 1}"), fresh, key)
        fresh.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def drain(stream: DataFrame, checkpoint: str, name: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into a table in memory, then ends."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
