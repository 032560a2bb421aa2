"""Queries p10_: keyword-stuffed and link-list documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.stuffing import line_shares, stuffed_pages
from quire.sources.tables import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(table(spark, folder, "documents"), "doc_id", "text").select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return line_shares(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares}
SQL: dict[str, str] = {}
