"""Queries p3_: consensus of the judges of bridge candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import blank_to_null
from quire.llm.consensus import consensus, latest_answers, reliabilities
from quire.sources.tables import table

TASKS = {"semantic_equivalence": "semantic_equivalence", "bridge_validity": "bridge_validity"}
#: Consensus at this or more rounds to level 3 or more.
LEVEL_3 = 2.5


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "judgements").where("parse_ok")
    for c in TASKS.values():
        rows = rows.where(F.col(c).between(1, 5))
    rows = rows.withColumn("judge", F.lower(blank_to_null("judge"))).where("judge is not null and candidate_id is not null")
    return latest_answers(rows, "candidate_id", "judge", "judged_at", TASKS)


def _consensus(spark: SparkSession, folder: str) -> DataFrame:
    answers = _answers(spark, folder)
    return consensus(answers, reliabilities(answers))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _consensus(spark, folder)
        .groupBy(F.col("item").alias("candidate_id"))
        .agg(F.min(F.coalesce(F.col("consensus") >= LEVEL_3, F.lit(False))).alias("both"))
        .where("both")
        .select("candidate_id")
    )


def p3_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).withColumnRenamed("item", "candidate_id")


def p3_judges(spark: SparkSession, folder: str) -> DataFrame:
    return reliabilities(_answers(spark, folder)).withColumnRenamed("annotator", "judge")


QUERIES = {"p3_found": p3_found, "p3_consensus": p3_consensus, "p3_judges": p3_judges}
SQL: dict[str, str] = {}
