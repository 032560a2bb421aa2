"""Queries p7_: works with the most similar abstract vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import work_id
from quire.llm.neighbours import similar_vectors
from quire.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "abstract_vectors").select(work_id("node_id").alias("node_id"), "vector")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    near = similar_vectors(_vectors(spark, folder), "node_id", "vector", k=5, least=0.8)
    return near.select(
        F.least("key_a", "key_b").alias("node_id_a"), F.greatest("key_a", "key_b").alias("node_id_b")
    ).distinct()


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar works of every work whose number is divisible by 20, against all works."""
    # neighbours that are hardly similar are harder to find than near ones: they go to more shards
    twentieth = lambda k: F.pmod(F.substring(k, 2, 20).try_cast("bigint"), F.lit(20)) == 0
    near = similar_vectors(_vectors(spark, folder), "node_id", "vector", k=5, spill=4, beam=48, asks=twentieth)
    return near.select(
        F.col("key_a").alias("node_id"), F.col("key_b").alias("neighbour_id"), "place", F.round("similarity", 6).alias("similarity")
    )


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours}
SQL: dict[str, str] = {}
