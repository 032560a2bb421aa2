"""Queries p8_ and p9_: token ids of all documents; a mixture of sources by tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import blank_to_null
from quire.llm.mixing import mixture, shares
from quire.llm.tokens import token_counts, token_ids
from quire.session import cut
from quire.sources.tables import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    source = lambda df: df.withColumn("source", F.lower(blank_to_null("source")))
    docs = source(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return cut(token_counts(docs, ["doc_id", "source"], "text")), source(table(spark, folder, "mix_targets"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(*_sized(spark, folder))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    docs, targets = _sized(spark, folder)
    return shares(docs, targets, mixture(docs, targets))


QUERIES = {"p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares}
SQL: dict[str, str] = {}
