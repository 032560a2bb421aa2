"""Queries p1_: orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.orphans import orphan_references, orphans_by_period, work_references
from quire.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs, parents = work_references(table(spark, folder, "papers"), table(spark, folder, "authorships"))
    return orphan_references(refs, parents)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "record_id", "ref_id")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, folder))


_ID = r"nullif(upper(regexp_extract({0}, '([^/\s]+)[/\s]*$', 1)), '')"
_ORPHANS = f"""
WITH rows_ AS (SELECT {_ID.format('openalex_id')} AS w, ingested_at AS ts, referenced_works AS refs,
    coalesce(lower(trim(status, E' \\t\\n\\r')) = 'deleted', false) AS gone FROM papers),
works AS (SELECT w, min(ts) AS first_seen, arg_max(gone, (ts, gone)) AS deleted
    FROM rows_ WHERE w IS NOT NULL GROUP BY w),
cited AS (SELECT DISTINCT w, {_ID.format('ref')} AS r FROM (SELECT w, unnest(refs) AS ref FROM rows_ WHERE w IS NOT NULL)),
refs AS (
    SELECT 'papers' AS table_name, c.w AS record_id, c.r AS ref_id, first_seen AS since
    FROM cited c JOIN works USING (w) WHERE r IS NOT NULL
    UNION ALL
    SELECT 'authorships', a, p, min(ingested_at) FROM (
        SELECT nullif(upper(trim(author_id, E' \\t\\n\\r')), '') AS a, {_ID.format('paper_id')} AS p, ingested_at FROM authorships)
    WHERE a IS NOT NULL AND p IS NOT NULL GROUP BY a, p),
orphans AS (SELECT * FROM (
    SELECT r.*, CASE WHEN w IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN first_seen > since THEN 'late' END AS cause
    FROM refs r LEFT JOIN works ON w = ref_id) WHERE cause IS NOT NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

SQL = {
    "p1_found": _ORPHANS + "SELECT table_name, record_id, ref_id FROM orphans",
    "p1_report": _ORPHANS
    + """SELECT table_name, CAST(date_trunc('month', since) AS DATE) AS period, cause, count(*) AS n_references,
    count(DISTINCT record_id) AS n_records, count(DISTINCT ref_id) AS n_parents FROM orphans GROUP BY ALL""",
}
