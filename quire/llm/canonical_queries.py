"""Queries p5_: ingredient labels mapped to the list of foods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.canonical import NONE, map_to_list
from quire.sources.tables import table


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "foodon_terms")
    every = F.concat(F.array("foodon_label"), F.coalesce("alt_labels", F.array().cast("array<string>")))
    names = terms.select("foodon_id", F.explode(every).alias("name"))
    return map_to_list(table(spark, folder, "ingredients"), "node_id", "label", names, "foodon_id", "name")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).select("node_id", "foodon_id")


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes that mean no entry, with their labels and occurrences."""
    rows = table(spark, folder, "ingredients").groupBy("node_id").agg(F.min("label").alias("label"), F.max("n_occurrences").alias("n_occurrences"))
    return _mapped(spark, folder).where(F.col("foodon_id") == NONE).select("node_id").join(rows, "node_id")


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched}
SQL: dict[str, str] = {}
