"""Mixing sources to target shares by hash thresholds, without sorting a source.

Every document has a 48-bit hash of its id. Tokens are summed by source and the hash's top 12 bits;
a running sum over these 4,096 buckets finds the bucket in which a source's budget ends. Only that
bucket is summed again by the next 12 bits, and only one of its parts, about a 16-millionth of the
source, is looked at document by document. Documents below the threshold are taken. Thresholds of a
smaller total lie below those of a larger one, so mixtures are nested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: More sources with a target than this are refused: the plan of all of them is broadcast.
MAX_SOURCES = 10_000


def _budgets(totals: dict[str, int], targets: list, total_tokens: float | None) -> tuple[float, list[tuple]]:
    """(total, [(source, target_share, max_repeats, available, full, rest)]): how often each source
    is taken whole, and how many tokens more it gives in part."""
    wanted = {}
    for t in targets:
        if t["source"] is not None and (t["target_share"] or 0) > 0 and t["source"] not in wanted:
            wanted[t["source"]] = (float(t["target_share"]), max(0, int(t["max_repeats"] if t["max_repeats"] is not None else 1)))
    usable = {s: x for s, x in wanted.items() if totals.get(s, 0) > 0 and x[1] > 0}
    whole = sum(share for share, _ in usable.values())
    if total_tokens is None:
        total_tokens = min((totals[s] * most * whole / share for s, (share, most) in usable.items()), default=0.0)
    plan = []
    for s, (share, most) in wanted.items():
        available = totals.get(s, 0)
        budget = min(int(share / whole * total_tokens), available * most) if s in usable else 0
        full = budget // available if available else 0
        plan.append((s, share, most, available, int(full), int(budget - full * available)))
    return total_tokens, plan


def _cut(hist: DataFrame, bucket: str, rest: str) -> DataFrame:
    """Per source the bucket in which the running sum passes ``rest``, and what is left for it."""
    upto = Window.partitionBy("source").orderBy(bucket)
    return (
        hist.withColumn("upto", F.sum("tokens").over(upto))
        .where(F.col("upto") > F.col(rest))
        .withColumn("first", F.row_number().over(upto))
        .where("first = 1")
        .select("source", bucket, (F.col(rest) - F.col("upto") + F.col("tokens")).alias(f"{bucket}_left"))
    )


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents drawn, each with how often.

    ``docs`` has doc_id, source, n_tokens; ``targets`` source, target_share, max_repeats (null: 1).
    Each source gives its share of ``total_tokens``: whole passes first, then the documents of lowest
    hash while they fit. Without ``total_tokens`` it is the largest total at which every source
    that has documents keeps its share. Sources without documents can't give any; their share goes
    to the others in proportion. With ``total_tokens``, a source too small gives what it has at
    ``max_repeats``. Sources without a target give nothing. Documents with equal hash and id are
    taken together or not at all; null ids hash alike. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").orderBy(F.desc("target_share")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    names = [r["source"] for r in rows if r["source"] is not None]
    hashed = (
        docs.select("doc_id", "source", "n_tokens", F.shiftrightunsigned(F.xxhash64("doc_id"), 16).alias("h"))
        .where(F.col("source").isin(names) if names else F.lit(False))
        .withColumn("b1", F.shiftright("h", 36).cast("int"))
    )
    hist = hashed.groupBy("source", "b1").agg(F.sum("n_tokens").alias("tokens"))
    totals = {r["source"]: r["t"] for r in hist.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    _, plan = _budgets(totals, rows, total_tokens)
    planned = spark.createDataFrame(
        [(s, full, rest) for s, _, _, _, full, rest in plan], "source string, full bigint, rest bigint"
    )
    first = planned.join(_cut(hist.join(F.broadcast(planned), "source"), "b1", "rest"), "source", "left").select(
        "source", "full", F.col("b1").alias("c1"), F.coalesce("b1_left", F.lit(0)).alias("left1")
    )
    there = hashed.join(F.broadcast(first), "source")
    edge = there.where("b1 = c1").withColumn("b2", F.shiftright("h", 24).bitwiseAND(4095).cast("int"))
    hist2 = edge.groupBy("source", "b2").agg(F.sum("n_tokens").alias("tokens"), F.first("left1").alias("left1"))
    second = _cut(hist2, "b2", "left1")
    key = F.struct("h", "doc_id")
    third = (
        edge.join(F.broadcast(second), ["source", "b2"])
        .withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("source").orderBy("h", "doc_id")))  # ties count together
        .where("upto <= b2_left")
        .groupBy("source")
        .agg(F.max(key).alias("c3"))
    )
    bounds = first.join(second.select("source", F.col("b2").alias("c2")), "source", "left").join(third, "source", "left")
    low = F.shiftright("h", 24).bitwiseAND(4095)
    within = (
        (F.col("b1") < F.coalesce("c1", F.lit(4096)))
        | (F.col("b1") == F.col("c1"))
        & ((low < F.coalesce("c2", F.lit(4096))) | (low == F.col("c2")) & F.coalesce(key <= F.col("c3"), F.lit(False)))
    )
    # a source without a boundary bucket has no partial pass left to give
    partial = F.when(F.col("c1").isNotNull() & within, 1).otherwise(0)
    return (
        hashed.join(F.broadcast(bounds), "source")
        .select("doc_id", "source", "n_tokens", (F.col("full") + partial).cast("int").alias("copies"))
        .where("copies > 0")
    )


def shares(docs: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """What each source gives: one row per source of ``docs`` or ``targets``, the null source too.

    Has target_share (null without a target), max_repeats, tokens_there, docs_there, tokens_drawn,
    docs_drawn, most_copies and actual_share, which is 0 for sources that give nothing.
    """
    none = lambda kind: F.lit(None).cast(kind)
    parts = (
        docs.select("source", none("double").alias("share"), none("int").alias("most"), "n_tokens", none("int").alias("copies"))
        .unionByName(drawn.select("source", none("double").alias("share"), none("int").alias("most"), "n_tokens", "copies"))
        .unionByName(
            targets.select(
                "source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"),
                none("bigint").alias("n_tokens"), none("int").alias("copies"),
            )
        )
    )
    there, taken = F.col("n_tokens").isNotNull() & F.col("copies").isNull(), F.col("copies").isNotNull()
    sums = parts.groupBy("source").agg(
        F.max("share").alias("target_share"),
        F.max("most").alias("max_repeats"),
        F.coalesce(F.sum(F.when(there, F.col("n_tokens"))), F.lit(0)).alias("tokens_there"),
        F.count(F.when(there, 1)).alias("docs_there"),
        F.coalesce(F.sum(F.when(taken, F.col("n_tokens") * F.col("copies"))), F.lit(0)).alias("tokens_drawn"),
        F.count(F.when(taken, 1)).alias("docs_drawn"),
        F.coalesce(F.max("copies"), F.lit(0)).alias("most_copies"),
    )
    whole = F.sum("tokens_drawn").over(Window.partitionBy())  # over one row per source
    return sums.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_drawn"), whole), F.lit(0.0)))
