"""Curation of entity records: pools, merge proposals, their triage, and repairs of nested lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import fold_accents, jaccard, one_blank, words


def entity_pool(mentions: DataFrame, entity: Column, form: str, confidence: str, noise: str) -> DataFrame:
    """(entity, n, mean_confidence, forms, is_noise) of mentions: distinct forms sorted, noise if any
    mention says so."""
    return mentions.withColumn("_e", entity).where("_e is not null").groupBy(F.col("_e").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.array_sort(F.collect_set(form)).alias("forms"), F.coalesce(F.max(noise), F.lit(False)).alias("is_noise")
    )


def fold_edges(edges: DataFrame, kind: list[str], confidence: str) -> DataFrame:
    """Repeated edges as one: mentions, greatest confidence, all confidences sorted."""
    return edges.groupBy("src", "dst", *kind).agg(F.count(F.lit(1)).alias("n_mentions"), F.max(confidence).alias("confidence"), F.array_sort(F.collect_list(confidence)).alias("confidences"))


def containment_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """(a, b) of texts of which one contains the other as whole words, found by the shorter one's first
    word instead of by comparing all pairs."""
    side = lambda df, c: df.select(F.col(c).alias("t")).where(F.length(c) >= least).distinct().select("t", words("t", 1, pattern="[a-z0-9]+").alias("w")).where("size(w) > 0")
    l, r = side(left, a), side(right, b)

    def inside(small: DataFrame, large: DataFrame, small_first: bool) -> DataFrame:
        s = small.select(F.col("t").alias("s"), F.col("w")[0].alias("k"), F.array_join("w", " ").alias("sw"))
        g = large.select(F.col("t").alias("g"), F.explode(F.array_distinct("w")).alias("k"), F.array_join("w", " ").alias("gw"))
        hit = s.join(g, "k").where(F.concat(F.lit(" "), "gw", F.lit(" ")).contains(F.concat(F.lit(" "), "sw", F.lit(" "))))
        return hit.select(F.col("s" if small_first else "g").alias("a"), F.col("g" if small_first else "s").alias("b"))

    return inside(l, r, True).union(inside(r, l, False)).distinct()


def proposals(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """Merge proposals of pairs (a, b, similarity): the more frequent entity is the root, the smaller
    name of equal ones; with the words' evidence and what to do.

    ``pool`` has entity and n. Actions: merge for the same words in another order or a high likeness
    with all words of one in the other, review for shared words or high likeness, else discard.
    """
    n = lambda x: pool.select(F.col("entity").alias(x), F.col("n").alias(f"n_{x}"))
    x = pairs.join(n("a"), "a").join(n("b"), "b")
    first = (F.col("n_a") > F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") <= F.col("b"))
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    wa, wb = (words(fold_accents(one_blank(c)), 1, pattern="[a-z0-9]+") for c in ("a", "b"))
    same = (F.array_sort(wa) == F.array_sort(wb)) & (F.col("a") != F.col("b"))
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    action = F.when(same, "merge").when((F.col("similarity") >= 0.9) & within, "merge").when((jaccard(wa, wb) > 0) | (F.col("similarity") >= 0.9), "review").otherwise("discard")
    return x.select(
        pick("a", "b").alias("root"), pick("b", "a").alias("merged"), "similarity", pick("n_a", "n_b").alias("n_root"), pick("n_b", "n_a").alias("n_merged"),
        same.alias("is_anagram"), within.alias("is_contained"), jaccard(wa, wb).alias("token_overlap"), action.alias("action"),
    )


def by_hub(review: DataFrame) -> DataFrame:
    """Proposals grouped by root: how many, their likeness, and one line that lists them, best first."""
    item = F.struct((-F.col("similarity")).alias("s"), F.col("merged").alias("m"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["m"], F.lit(" ("), F.format_number(-x["s"], 4), F.lit(")"))), "; ")
    return review.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("most"), F.min("similarity").alias("least"), line.alias("candidates"))


def listed(hubs: DataFrame) -> DataFrame:
    """(root, merged, similarity) read back from the lines that :func:`by_hub` makes."""
    names = F.regexp_extract_all("candidates", F.lit(r"([^;]+?) \([0-9.]+\)(?:; |$)"), 1)
    sims = F.regexp_extract_all("candidates", F.lit(r" \(([0-9.]+)\)(?:; |$)"), 1)
    return hubs.select("root", F.explode(F.arrays_zip(names.alias("merged"), sims.alias("similarity"))).alias("x")).select("root", F.trim("x.merged").alias("merged"), F.col("x.similarity").cast("double").alias("similarity"))


def reconciled(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Every (root, merged) that was asked with its decision; unanswered ones are UNKNOWN, answers to
    what wasn't asked are ignored, the last of several counts by ``at``."""
    last = answers.groupBy("root", "merged").agg(F.max(F.struct("at", "decision"))["decision"].alias("decision"))
    return asked.select("root", "merged").distinct().join(last, ["root", "merged"], "left").withColumn("decision", F.coalesce(F.upper(F.trim("decision")), F.lit("UNKNOWN")))


def merged_items(df: DataFrame, key: str, items: str, name: str, confidence: str, forms: str) -> DataFrame:
    """Records with the items of an array of structs merged by name in any case: greatest confidence,
    all forms; items without a name are dropped, sorted by name. A record without items keeps an empty
    array."""
    x = df.select(key, F.explode_outer(items).alias("i")).select(key, F.lower(one_blank(f"i.{name}")).alias("name"), F.col(f"i.{confidence}").alias("c"), F.coalesce(f"i.{forms}", F.array().cast("array<string>")).alias("f"))
    one = x.groupBy(key, "name").agg(F.max("c").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("forms"))
    item = F.struct("name", "confidence", "forms")
    return one.groupBy(key).agg(F.array_sort(F.filter(F.collect_list(item), lambda i: i["name"].isNotNull() & (i["name"] != ""))).alias("items"))


def paired_lists(a: Column, b: Column, mark: str = ";") -> Column:
    """Two delimited texts as an array of pairs by place, to the shorter one's length; null gives none."""
    x, y = F.split(a, mark), F.split(b, mark)
    n = F.least(F.size(x), F.size(y))
    return F.coalesce(F.transform(F.slice(F.arrays_zip(x.alias("x"), y.alias("y")), 1, n), lambda p: F.struct(F.trim(p["x"]).alias("a"), F.trim(p["y"]).alias("b"))), F.array().cast("array<struct<a:string,b:string>>"))


def looked_up(df: DataFrame, key: str, ids: Column, lookup: DataFrame, id_: str, value: str) -> DataFrame:
    """(key, n_found, mean): the mean of a lookup's value over a row's list of ids."""
    x = df.select(key, F.explode_outer(ids).alias("_i")).join(lookup.select(F.col(id_).alias("_i"), F.col(value).alias("_v")), "_i", "left")
    return x.groupBy(key).agg(F.count("_v").alias("n_found"), F.avg("_v").alias("mean"))


def classified(items: DataFrame, record: str, item: str, signatures: DataFrame, least: int) -> DataFrame:
    """(record, region, hits): the region of whose markers a record has most, at least ``least``; the
    greater region of equal ones. ``signatures`` is (region, marker)."""
    hit = items.select(F.col(record).alias("record"), F.col(item).alias("marker")).distinct().join(signatures.select("region", "marker").distinct(), "marker")
    n = hit.groupBy("record", "region").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    return n.groupBy("record").agg(F.max(F.struct("hits", "region")).alias("x")).select("record", "x.region", "x.hits")


def flagged_without(nodes: DataFrame, edges: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the bad nodes and what touches them."""
    keep = nodes.where(~F.coalesce(bad, F.lit(False)))
    ids = keep.select("id")
    e = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return keep, e
