"""Items that appear together: pair counts and lift by basket collapsing.

Each record is a basket of distinct items. Items that cannot be in any reported pair are dropped
exactly first; the remaining arrays are sorted and identical ones collapse into one basket with a
weight, so that pairs are enumerated once per distinct basket and their weights summed.

Two exact prunings follow from n_ab <= min(n_a, n_b). A pair with n_ab >= ``min_count`` needs
n_a, n_b >= ``min_count``; a pair with n_ab * n >= ``min_lift`` * n_a * n_b needs
n_a, n_b <= n / ``min_lift``. The second drops every item that a large share of records holds
before any pair is made of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def incidence(records: DataFrame) -> DataFrame:
    """Distinct (kind, record, item) of ``records`` (record, kind, items ARRAY<STRING>).

    Null records, items and arrays count for nothing; an item counts once per record and kind,
    over all rows of the record. Repeats combine before the shuffle.
    """
    return (
        records.where(F.col("record").isNotNull())
        .select("kind", "record", F.explode(F.array_distinct("items")).alias("item"))
        .where(F.col("item").isNotNull())
        .distinct()
    )


def collapse(kept: DataFrame) -> DataFrame:
    """(kind, basket, weight): the sorted item arrays of at least two items, and how many records
    have exactly that array."""
    return (
        kept.groupBy("kind", "record")
        .agg(F.array_sort(F.collect_list("item")).alias("basket"))
        .where(F.size("basket") >= 2)
        .groupBy("kind", "basket")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def pair_counts(baskets: DataFrame, min_count: int) -> DataFrame:
    """(kind, item_a, item_b, n_ab) with item_a < item_b and n_ab >= ``min_count``.

    The tails of a basket are made row by row, so a long basket streams and is never one value.
    """
    return (
        baskets.select("kind", "weight", "basket", F.posexplode("basket").alias("i", "item_a"))
        .select("kind", "weight", "item_a", F.explode(F.slice("basket", F.col("i") + 2, F.size("basket"))).alias("item_b"))
        .groupBy("kind", "item_a", "item_b")
        .agg(F.sum("weight").alias("n_ab"))
        .where(F.col("n_ab") >= min_count)
    )


def pairs_with_lift(records: DataFrame, min_count: int = 4, min_lift: float = 6.0) -> DataFrame:
    """Pairs of items in at least ``min_count`` records and ``min_lift`` times as often as chance.

    Gives kind, item_a, item_b, n_ab, n_a, n_b, n (records with an item of the kind), lift =
    n_ab * n / (n_a * n_b) and conviction of a => b, (1 - n_b / n) / (1 - n_ab / n_a), null where
    a never occurs without b. No records, or no pair, give no rows.
    """
    inc = incidence(records)
    # records per kind: a fold of single record keys, not of whole rows
    totals = inc.select("kind", "record").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    counts = inc.groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n_item"))
    # one row per kind: broadcasting it is bounded by the number of kinds
    usable = (
        counts.where(F.col("n_item") >= min_count)
        .join(F.broadcast(totals), "kind")
        .where(F.col("n_item") * F.lit(min_lift) <= F.col("n"))
    )
    # at most min_lift times the mean basket's size of items are too common: a bounded broadcast
    common = (
        counts.join(F.broadcast(totals), "kind").where(F.col("n_item") * F.lit(min_lift) > F.col("n")).select("kind", "item")
    )
    kept = inc.join(F.broadcast(common), ["kind", "item"], "left_anti").join(
        usable.select("kind", "item"), ["kind", "item"], "left_semi"
    )
    found = pair_counts(collapse(kept), min_count)
    side = lambda x: usable.select("kind", F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"))
    a, b, ab, n = (F.col(x).cast("double") for x in ("n_a", "n_b", "n_ab", "n"))
    return (
        found.join(side("a"), ["kind", "item_a"])
        .join(side("b"), ["kind", "item_b"])
        .join(F.broadcast(totals), "kind")
        .where(ab * n >= F.lit(min_lift) * a * b)
        .select(
            "kind", "item_a", "item_b", "n_ab", "n_a", "n_b", "n",
            (ab * n / (a * b)).alias("lift"),
            F.when(ab < a, (1 - b / n) / (1 - ab / a)).alias("conviction"),
        )
    )


def works_as_records(papers: DataFrame, work_id) -> DataFrame:
    """Each row of ``papers`` as two records of its work: its concepts and its authors."""
    keys = lambda c, f: F.transform(c, lambda x: F.nullif(F.upper(F.trim(x[f])), F.lit("")))
    kinds = F.array(
        F.struct(F.lit("concept").alias("kind"), keys("concepts", "concept_id").alias("items")),
        F.struct(F.lit("author").alias("kind"), keys("authorships", "author_id").alias("items")),
    )
    return papers.select(work_id("openalex_id").alias("record"), F.explode(kinds).alias("k")).select("record", "k.kind", "k.items")
