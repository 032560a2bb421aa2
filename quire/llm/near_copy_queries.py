"""Queries p6_: works that carry nearly the same title and abstract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import work_id
from quire.llm.near_copies import classes_and_links, record_pairs
from quire.operators.graph import connected_components
from quire.session import cut
from quire.sources.tables import table


def _classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    papers = table(spark, folder, "papers").select(work_id("openalex_id").alias("work"), "title", "abstract")
    return classes_and_links(papers, "work", "title", "abstract")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return record_pairs(*_classes(spark, folder)).select(
        F.col("key_a").alias("openalex_id_a"), F.col("key_b").alias("openalex_id_b")
    )


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every work that counts with its class of equal texts, its group of linked ones and its links."""
    members, links = _classes(spark, folder)
    links = cut(links)
    ends = links.select(F.col("cls_a").alias("src"), F.col("cls_b").alias("dst"))
    groups = connected_components(ends).select(F.col("id").alias("cls"), F.col("component"))
    degree = ends.union(ends.select("dst", "src")).groupBy(F.col("src").alias("cls")).agg(F.count(F.lit(1)).alias("n_links"))
    first = members.groupBy("cls").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    named = first.join(groups, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    group = named.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return (
        members.join(named.join(group, "component"), "cls")
        .join(degree, "cls", "left")
        .select(
            F.col("key").alias("openalex_id"), "class_id", "class_size", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_linked_classes")
        )
    )


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
SQL: dict[str, str] = {}
