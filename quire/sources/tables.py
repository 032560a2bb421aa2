"""The tables of a data folder, one Parquet table each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
