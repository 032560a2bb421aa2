"""The canonical works and their links, out of delivered papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import blank_to_null, doi_key, work_id
from quire.sources.tables import table


def works(spark: SparkSession, folder: str) -> DataFrame:
    """One row per work, its latest delivery: work, doi, title, abstract, year, citations, type,
    is_oa, language, cluster, concepts, authors, refs. Impossible years are null; arrays are distinct
    and sorted, never null, without null or blank elements. Deliveries combine before the shuffle.
    """
    p = table(spark, folder, "papers")
    ids = lambda c, f: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array()), f), lambda x: x.isNotNull())))
    kept = ["doi", "title", "abstract", "publication_year", "citations", "type", "is_oa", "language", "topic_cluster", "concepts", "authorships", "referenced_works"]
    # one aggregate a column, so that columns nobody reads leave the plan, the shuffle and the scan
    last = [F.max_by(c, F.struct("ingested_at", "openalex_id")).alias(c) for c in kept]
    x = p.groupBy(work_id("openalex_id").alias("work")).agg(*last).where("work is not null")
    year = F.when(F.col("publication_year").between(1500, 2100), F.col("publication_year"))
    return x.select(
        "work", doi_key("doi").alias("doi"), "title", "abstract", year.alias("year"), "citations", "type", "is_oa",
        F.lower(blank_to_null("language")).alias("language"), F.col("topic_cluster").alias("cluster"),
        ids(F.transform("concepts", lambda c: c["concept_id"]), blank_to_null).alias("concepts"),
        ids(F.transform("authorships", lambda a: a["author_id"]), blank_to_null).alias("authors"),
        ids(F.col("referenced_works"), work_id).alias("refs"),
    )


def citations(w: DataFrame) -> DataFrame:
    """Distinct (src, dst) between works that are there, without self-citations."""
    e = w.select(F.col("work").alias("src"), F.explode("refs").alias("dst")).where("src <> dst")
    return e.join(w.select(F.col("work").alias("dst")), "dst", "left_semi").select("src", "dst")


#: The same in SQL: a WITH list to be continued.
WORKS_SQL = r"""
raw AS (SELECT nullif(upper(regexp_extract(openalex_id, '([^/\s]+)[/\s]*$', 1)), '') AS work, * FROM papers),
ranked AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY ingested_at DESC, openalex_id DESC) AS rn FROM raw WHERE work IS NOT NULL),
works AS (SELECT work, nullif(lower(regexp_extract(doi, '(10\.\d{4,9}/\S+)', 1)), '') AS doi, title, abstract,
    CASE WHEN publication_year BETWEEN 1500 AND 2100 THEN publication_year END AS year, citations, type, is_oa,
    nullif(lower(trim(language)), '') AS language, topic_cluster AS cluster,
    list_sort(list_distinct(list_filter(list_transform(coalesce(concepts, []), lambda c: nullif(trim(c.concept_id), '')), lambda x: x IS NOT NULL))) AS concepts,
    list_sort(list_distinct(list_filter(list_transform(coalesce(authorships, []), lambda a: nullif(trim(a.author_id), '')), lambda x: x IS NOT NULL))) AS authors,
    list_sort(list_distinct(list_filter(list_transform(coalesce(referenced_works, []), lambda r: nullif(upper(regexp_extract(r, '([^/\s]+)[/\s]*$', 1)), '')), lambda x: x IS NOT NULL))) AS refs
    FROM ranked WHERE rn = 1)
"""
CITATIONS_SQL = """
refs_ AS (SELECT work AS src, unnest(refs) AS dst FROM works),
cites AS (SELECT src, dst FROM refs_ WHERE src <> dst AND dst IN (SELECT work FROM works))
"""
