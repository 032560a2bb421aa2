"""References to records that do not exist: missing, deleted or late parents.

The references and the parents' validity intervals are hash-partitioned and sorted on the key
that is referred to and then merged in one pass (Spark's sort-merge join). A key to which a large
share of all references points is split by adaptive execution: the left side of the outer join is
the references, so a hot partition is cut and its single parent row is sent to each piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ids import blank_to_null, work_id


def validity(rows: DataFrame, key: Column, at: str, gone: Column) -> DataFrame:
    """One row per key: ``parent_id``, ``first_seen`` (earliest ``at``) and ``deleted`` (of the
    row with the latest ``at``; a deletion wins a tie, null ``gone`` is false, null times come first).
    """
    return (
        rows.select(key.alias("parent_id"), F.col(at).alias("at"), F.coalesce(gone, F.lit(False)).alias("gone"))
        .where(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.min("at").alias("first_seen"), F.max(F.struct("at", "gone"))["gone"].alias("deleted"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Those of ``refs`` (table_name, record_id, ref_id, since) whose parent has no valid interval
    at ``since``, with ``cause``: missing, deleted or late, the first that holds.

    ``parents`` is what :func:`validity` gives. An unknown ``since`` is never late. Null ids must
    not be among the references; repeated references are kept as given.
    """
    late = F.col("first_seen") > F.col("since")
    cause = F.when(F.col("parent_id").isNull(), "missing").when(F.col("deleted"), "deleted").when(late, "late")
    return (
        refs.join(parents.hint("merge"), F.col("ref_id") == F.col("parent_id"), "left")
        .select("table_name", "record_id", "ref_id", "since", cause.alias("cause"))
        .where(F.col("cause").isNotNull())
    )


def work_references(papers: DataFrame, authorships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of both tables, each once, and the works' validity intervals.

    A record refers from its earliest ``ingested_at`` on. Rows without an id, and null or blank
    elements, refer to nothing. Repeats are combined before each shuffle.
    """
    parents = validity(
        papers, work_id("openalex_id"), "ingested_at", F.lower(blank_to_null("status")) == "deleted"
    )
    cited = (
        papers.select(
            work_id("openalex_id").alias("record_id"),
            F.explode(F.array_distinct(F.transform("referenced_works", work_id))).alias("ref_id"),
        )
        .where(F.col("record_id").isNotNull() & F.col("ref_id").isNotNull())
        .distinct()
        .join(parents.select(F.col("parent_id").alias("record_id"), F.col("first_seen").alias("since")), "record_id")
    )
    written = (
        authorships.select(
            F.upper(blank_to_null("author_id")).alias("record_id"), work_id("paper_id").alias("ref_id"), "ingested_at"
        )
        .where(F.col("record_id").isNotNull() & F.col("ref_id").isNotNull())
        .groupBy("record_id", "ref_id")
        .agg(F.min("ingested_at").alias("since"))
    )
    columns = ["table_name", "record_id", "ref_id", "since"]
    refs = (
        cited.withColumn("table_name", F.lit("papers"))
        .select(columns)
        .unionByName(written.withColumn("table_name", F.lit("authorships")).select(columns))
    )
    return refs, parents


def orphans_by_period(orphans: DataFrame, unit: str = "month") -> DataFrame:
    """Orphans counted by table, period of ``since`` and cause; an unknown ``since`` has a null period."""
    return orphans.groupBy(
        "table_name", F.to_date(F.date_trunc(unit, F.col("since"))).alias("period"), "cause"
    ).agg(
        F.count(F.lit(1)).alias("n_references"),
        F.countDistinct("record_id").alias("n_records"),
        F.countDistinct("ref_id").alias("n_parents"),
    )
