"""Queries p2_: concepts and authors that occur together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import work_id
from quire.llm.pairs import pairs_with_lift, works_as_records
from quire.sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_with_lift(works_as_records(table(spark, folder, "papers"), work_id))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(F.col("kind").alias("item_kind"), "item_a", "item_b")


def p2_lift(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(
        F.col("kind").alias("item_kind"), "item_a", "item_b", "n_ab", "n_a", "n_b",
        F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"),
    )


_PAIRS = r"""
WITH rows_ AS (SELECT nullif(upper(regexp_extract(openalex_id, '([^/\s]+)[/\s]*$', 1)), '') AS w, concepts, authorships FROM papers),
inc AS (SELECT DISTINCT k, w, i FROM (
    SELECT 'concept' AS k, w, nullif(upper(trim(x.concept_id)), '') AS i FROM (SELECT w, unnest(concepts) AS x FROM rows_)
    UNION ALL
    SELECT 'author', w, nullif(upper(trim(x.author_id)), '') FROM (SELECT w, unnest(authorships) AS x FROM rows_))
    WHERE w IS NOT NULL AND i IS NOT NULL),
tot AS (SELECT k, count(DISTINCT w) AS n FROM inc GROUP BY k),
cnt AS (SELECT k, i, count(*) AS n_i FROM inc GROUP BY k, i),
pairs AS (SELECT a.k, a.i AS item_a, b.i AS item_b, count(*) AS n_ab FROM inc a JOIN inc b ON a.k = b.k AND a.w = b.w AND a.i < b.i
    GROUP BY ALL HAVING count(*) >= 4),
found AS (SELECT p.*, ca.n_i AS n_a, cb.n_i AS n_b, n FROM pairs p JOIN cnt ca ON ca.k = p.k AND ca.i = item_a
    JOIN cnt cb ON cb.k = p.k AND cb.i = item_b JOIN tot ON tot.k = p.k WHERE n_ab * n >= 6 * ca.n_i * cb.n_i)
"""

QUERIES = {"p2_found": p2_found, "p2_lift": p2_lift}

SQL = {
    "p2_found": _PAIRS + "SELECT k AS item_kind, item_a, item_b FROM found",
    "p2_lift": _PAIRS
    + """SELECT k AS item_kind, item_a, item_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift,
    CASE WHEN n_ab < n_a THEN round((1 - n_b::DOUBLE / n) / (1 - n_ab::DOUBLE / n_a), 6) END AS conviction FROM found""",
}
