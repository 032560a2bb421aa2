"""Retrieval: rankings of documents for queries, their fusion and their evaluation.

A ranking is (query, doc, place); terms are (id, term) tables; truth is (query, doc)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.relational import top_per_group
from quire.session import cut


def overlap_ranking(query_terms: DataFrame, doc_terms: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """The ``k`` documents that share most terms (or most of a weight) with each query, itself left
    out, ties by document; documents that share none aren't ranked."""
    w = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    q = query_terms.select(F.col("id").alias("query"), "term").distinct()
    d = doc_terms.select(F.col("id").alias("doc"), "term", *([weight] if weight else [])).distinct()
    s = q.join(d, "term").where("query <> doc").groupBy("query", "doc").agg(w.alias("score"))
    return top_per_group(s, ["query"], [F.desc("score"), F.asc("doc")], k).select("query", "doc", "place", "score")


def _overlaps(queries: DataFrame, docs: DataFrame, result, schema: str, block: int) -> DataFrame:
    """``result(query, doc ids in order, shared terms of each)`` of each query and each block of documents.

    Both are (id, terms: array). Every block of queries meets every block of documents; in a task the documents'
    terms are inverted lists, so that counting needs no shuffle of pairs however common a term is.
    """
    have = lambda x: cut(x.select("id", F.array_distinct("terms").alias("terms"))).where("id is not null and size(terms) > 0")
    q, d = have(queries), have(docs)
    nq, nd = (-(-x.count() // block) or 1 for x in (q, d))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = q.withColumn("other", each(nd)).select(F.lit(True).alias("asks"), "id", "terms", (own(nq) * nd + F.col("other")).alias("cell"))
    asked = d.withColumn("other", each(nq)).select(F.lit(False).alias("asks"), "id", "terms", (F.col("other") * nd + own(nd)).alias("cell"))
    columns = [x.split() for x in schema.split(", ")]

    def count(t: pa.Table) -> pa.Table:
        q = t.filter(t["asks"])
        d = t.filter(pc.invert(t["asks"])).sort_by("id")
        out = [[] for _ in columns]
        if q.num_rows and d.num_rows:
            ids, n = np.array(d["id"].to_pylist(), dtype=object), d.num_rows
            code = pc.list_flatten(d["terms"]).combine_chunks().dictionary_encode()
            of = np.repeat(np.arange(n), pc.list_value_length(d["terms"]).to_numpy())
            codes = code.indices.to_numpy()
            of = of[np.argsort(codes, kind="stable")]
            start = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(code.dictionary)))])
            asked = pc.fill_null(pc.index_in(pc.list_flatten(q["terms"]), value_set=code.dictionary), -1).to_numpy()
            ends = np.cumsum(pc.list_value_length(q["terms"]).to_numpy())
            for name, lo, hi in zip(q["id"].to_pylist(), np.concatenate([[0], ends[:-1]]), ends, strict=True):
                c = asked[lo:hi]
                c = c[c >= 0]
                if len(c):
                    shared = np.bincount(np.concatenate([of[i:j] for i, j in zip(start[c].tolist(), start[c + 1].tolist(), strict=True)]), minlength=n)
                    for column, values in zip(out, result(name, ids, shared), strict=True):
                        column.extend(values)
        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
        return pa.table({x: pa.array(v, kinds[kind]) for (x, kind), v in zip(columns, out, strict=True)})

    return asks.union(asked).groupBy("cell").applyInArrow(count, schema)


def overlap_top(queries: DataFrame, docs: DataFrame, k: int, block: int = 8000) -> DataFrame:
    """``overlap_ranking`` of (id, terms: array) with terms that most documents have: exact, in blocks."""

    def best(query, ids, shared):
        at = np.searchsorted(ids, query)
        if at < len(ids) and ids[at] == query:
            shared[at] = 0
        edge = max(1, np.partition(shared, len(shared) - k)[len(shared) - k] if k < len(shared) else 1)
        found = np.flatnonzero(shared >= edge)
        found = found[np.argsort(-shared[found], kind="stable")][:k]
        return [query] * len(found), ids[found].tolist(), shared[found].astype(float).tolist()

    s = _overlaps(queries, docs, best, "query string, doc string, score double", block)
    return top_per_group(s, ["query"], [F.desc("score"), F.asc("doc")], k).select("query", "doc", "place", "score")


def overlap_sizes(queries: DataFrame, docs: DataFrame, block: int = 8000) -> DataFrame:
    """``boolean_or`` of (id, terms: array) with terms that most documents have: exact, in blocks."""
    n = _overlaps(queries, docs, lambda query, ids, shared: ([query], [int(np.count_nonzero(shared))]), "query string, n bigint", block)
    return n.groupBy("query").agg(F.sum("n").alias("n_docs"))


def fuse(rankings: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: documents by the sum of 1 / (constant + place) over the rankings."""
    rows = rankings[0].select("query", "doc", "place")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query", "doc", "place"))
    s = rows.groupBy("query", "doc").agg(F.sum(1.0 / (constant + F.col("place"))).alias("score"))
    return top_per_group(s, ["query"], [F.desc(F.round("score", 12)), F.asc("doc")], k).select("query", "doc", "place", "score")


def expanded(query_terms: DataFrame, aligned: DataFrame, most: int = 3) -> DataFrame:
    """Query terms and, of each, the first ``most`` aligned terms (term, other, order)."""
    few = top_per_group(aligned.groupBy("term", "other").agg(F.min("order").alias("order")), ["term"], [F.asc("order"), F.asc("other")], most)
    return query_terms.select("id", "term").union(query_terms.join(few, "term").select("id", F.col("other").alias("term"))).distinct()


def recall_at(ranking: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(query, n_true, hits_k, recall_k ...) of every query that has true documents."""
    x = truth.select("query", "doc").distinct().join(ranking.select("query", "doc", "place"), ["query", "doc"], "left")
    hits = x.groupBy("query").agg(F.count(F.lit(1)).alias("n_true"), *(F.count_if(F.col("place") <= k).alias(f"hits_{k}") for k in ks))
    return hits.select("*", *((F.col(f"hits_{k}") / F.col("n_true")).alias(f"recall_{k}") for k in ks))


def precision_at(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query, n_returned, precision): true ones among those returned, at most ``k``."""
    top = ranking.where(F.col("place") <= k)
    x = top.join(truth.select("query", "doc").distinct().withColumn("ok", F.lit(1)), ["query", "doc"], "left")
    return x.groupBy("query").agg(F.count(F.lit(1)).alias("n_returned"), (F.sum(F.coalesce("ok", F.lit(0))) / F.count(F.lit(1))).alias("precision"))


def union_recall(rankings: dict[str, DataFrame], truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of true pairs each ranking finds within ``k``, any of them, and the gain."""
    x = truth.select("query", "doc").distinct()
    for name, r in rankings.items():
        x = x.join(r.where(F.col("place") <= k).select("query", "doc", F.lit(1).alias(name)), ["query", "doc"], "left").fillna(0, [name])
    any_ = F.greatest(*rankings) if len(rankings) > 1 else F.col(next(iter(rankings)))
    out = x.agg(F.count(F.lit(1)).alias("n_true"), *(F.avg(n).alias(n) for n in rankings), F.avg(any_).alias("any"))
    best = F.greatest(*rankings) if len(rankings) > 1 else F.col(next(iter(rankings)))
    return out.withColumn("gap", F.col("any") - best)


def boolean_or(query_terms: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(query, n_docs): documents with any of a query's terms."""
    return query_terms.select(F.col("id").alias("query"), "term").distinct().join(doc_terms.select(F.col("id").alias("doc"), "term").distinct(), "term").groupBy("query").agg(F.countDistinct("doc").alias("n_docs"))
