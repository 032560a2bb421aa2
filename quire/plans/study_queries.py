"""Queries of single studies: scores, rules, profiles and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null
from quire.operators import graph as G
from quire.operators import retrieval as Q
from quire.operators import spectra as P
from quire.operators import vectors as V
from quire.operators import vocabulary as C
from quire.operators.relational import top_per_group
from quire.plans import measure_queries as _m
from quire.plans import vocabulary_queries as _v
from quire.plans.measure_queries import _queries_terms
from quire.plans.vocabulary_queries import CATEGORIES, _tops
from quire.sources.tables import table
from quire.sources.works import WORKS_SQL, works


def cross_cutting(spark, folder):
    """Works whose words fall into at least two of the keyword categories."""
    w = works(spark, folder).select("work", F.explode(X.words(F.concat_ws(" ", "title", "abstract"), 3)).alias("t"))
    m = F.coalesce(*(F.when(F.col("t").isin(*v), k) for k, v in CATEGORIES.items()))
    return w.select("work", m.alias("c")).where("c is not null").groupBy("work").agg(F.countDistinct("c").alias("n")).where("n >= 2")


def relevance(spark, folder):
    """0.4 citations, 0.2 year, 0.3 terms, 0.1 length, each from 0 to 1."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    t = F.lower(F.concat_ws(" ", "title", "abstract"))
    hits = sum(F.when(t.contains(x), 1).otherwise(0) for x in ("compost", "glass", "starch")) / 3
    s = 0.4 * clip(F.log1p(F.coalesce("citations", F.lit(0)).cast("double")) / 6) + 0.2 * clip((F.coalesce("year", F.lit(2000)) - 2000) / 25) + 0.3 * hits + 0.1 * clip(F.length(F.coalesce("abstract", F.lit(""))) / 1500)
    return works(spark, folder).select("work", F.round(s, 8).alias("score"))


JUNK = ["ditto", "unknown", "illegible", "same", "sieve", "cloth", "kettle", "knife", "fire"]


def junk_labels(spark, folder):
    """The first rule by which a label is no entity: long phrase, number, junk word."""
    w = F.split(F.lower(X.one_blank("label")), " ")
    reason = F.when(F.size(w) >= 5, "phrase").when(F.exists(w, lambda x: x.rlike("^[0-9/.]+$")), "number").when(F.exists(w, lambda x: x.isin(*JUNK)), "junk")
    return table(spark, folder, "ingredients").where("label is not null").select("node_id", reason.alias("reason")).where("reason is not null").distinct()


def numeric_names(spark, folder):
    """Foods of which at least half of three or more spellings hold a digit."""
    i = table(spark, folder, "ingredients").where("label is not null").select(F.regexp_replace(X.fold_accents("label"), "[^a-z]+", "").alias("k"), F.lower("label").alias("l")).distinct()
    g = i.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l").rlike("[0-9]")).alias("m"))
    return g.where("n >= 3 and m >= 0.5 * n")


def running_index(spark, folder):
    s = F.coalesce(F.lower(blank_to_null("source")), F.lit("?"))
    d = table(spark, folder, "documents").select("doc_id", s.alias("source"))
    return d.withColumn("index", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)


def same_features(spark, folder):
    """Works with the same title in any case and the same concepts, the first of each kept."""
    w = works(spark, folder).where("title is not null")
    return w.groupBy(F.lower("title").alias("title"), "concepts").agg(F.min("work").alias("work"), F.count(F.lit(1)).alias("n")).select("work", "n")


def threshold_overlap(spark, folder):
    """Jaccard of the candidates above each two thresholds."""
    b = table(spark, folder, "bridge_candidates").where("sbert_cosine is not null")
    t = b.select(F.explode(F.array(*(F.struct(F.lit(x).alias("t"), (F.col("sbert_cosine") >= x).alias("in_")) for x in (0.5, 0.6, 0.7, 0.8)))).alias("x"), F.col("candidate_id").alias("term")).where("x.in_").select(F.col("x.t").alias("cluster"), "term")
    return C.vocabulary_jaccard(t.distinct()).withColumn("jaccard", F.round("jaccard", 8))


def region_paths(spark, folder):
    t = lambda n: table(spark, folder, n)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.concat_ws(" > ", F.lit("world"), "r_name", "n_name").alias("path"))


def neighbours_by_type(spark, folder):
    w = works(spark, folder)
    return w.select("work", F.explode(F.array(F.struct(F.lit("author").alias("kind"), F.size("authors").alias("n")), F.struct(F.lit("concept").alias("kind"), F.size("concepts").alias("n")), F.struct(F.lit("reference").alias("kind"), F.size("refs").alias("n")))).alias("x")).select("work", "x.kind", "x.n").where("n > 0")


def most_complete(spark, folder):
    w = works(spark, folder)
    score = sum(F.when(c, 1).otherwise(0) for c in (F.col("doi").isNotNull(), F.col("year").isNotNull(), F.length("abstract") > 100, F.size("authors") > 0, F.size("concepts") > 2, F.size("refs") > 0))
    return top_per_group(w.select("cluster", "work", score.alias("score"), F.coalesce("citations", F.lit(0)).alias("citations")), ["cluster"], [F.desc("score"), F.desc("citations"), F.asc("work")], 1).drop("place")


def concepts_as_text(spark, folder):
    """The five most frequent concepts of each cluster as one text."""
    n = works(spark, folder).select("cluster", F.explode("concepts").alias("c")).groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("n"))
    top = top_per_group(n, ["cluster"], [F.desc("n"), F.asc("c")], 5)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "c", "n"))), lambda x: F.concat(x["c"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ")
    return top.groupBy("cluster").agg(line.alias("concepts"))


def stable_extremes(spark, folder):
    """Cluster pairs by in how many settings their vocabularies hardly overlap."""
    tops, out = _tops(spark, folder), None
    for p in (0.8, 0.9):
        for n in (5, 12):
            one = C.rank_biased_overlap(tops, p, n).select("a", "b", (F.col("rbo") < 0.02).cast("int").alias("x"))
            out = one if out is None else out.union(one)
    return out.groupBy("a", "b").agg(F.sum("x").alias("n_extreme"))


def term_likeness(spark, folder):
    """Shared words of the two terms of each candidate, by category."""
    b = table(spark, folder, "bridge_candidates")
    j = X.jaccard(F.array_distinct(X.words("term_a", 1)), F.array_distinct(X.words("term_b", 1)))
    return b.select(F.coalesce(F.lower(F.trim("category")), F.lit("?")).alias("category"), j.alias("j")).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("j") == 0).alias("n_zero"), F.round(F.avg("j"), 8).alias("mean"))


def best_candidates(spark, folder):
    b = table(spark, folder, "bridge_candidates").where("sbert_cosine is not null").select(F.coalesce(F.lower(F.trim("category")), F.lit("?")).alias("category"), "cluster_a", "cluster_b", "candidate_id", "sbert_cosine")
    return top_per_group(b, ["category", "cluster_a", "cluster_b"], [F.desc("sbert_cosine"), F.asc("candidate_id")], 2)


def aligned_pairs(spark, folder):
    """Per pair of clusters: candidates that two judges or more score at 3 or above, of all judged."""
    j = table(spark, folder, "judgements").where("parse_ok and bridge_validity >= 3").groupBy("candidate_id").agg(F.countDistinct(F.lower(blank_to_null("judge"))).alias("k"))
    b = table(spark, folder, "bridge_candidates").groupBy("candidate_id").agg(F.min(F.struct("cluster_a", "cluster_b")).alias("x")).select("candidate_id", "x.*")
    return b.join(j, "candidate_id", "left").groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("k", F.lit(0)) >= 2).alias("n_aligned"))


def community_ranking(spark, folder):
    """Documents by shared words within the query's own cluster only."""
    w, t, q = _queries_terms(spark, folder)
    c = w.select(F.col("work").alias("id"), "cluster").where("cluster is not null")
    inside = lambda x: x.join(c, "id").select("id", F.transform("terms", lambda t: F.concat_ws(":", "cluster", t)).alias("terms"))
    return Q.overlap_top(inside(q), inside(t), 5).withColumn("score", F.col("score").cast("bigint"))


def bridge_works(spark, folder):
    """Works with at least two of the top terms of each of two clusters or more."""
    t = works(spark, folder).select("work", F.explode(F.array_distinct(X.words(F.concat_ws(" ", "title", "abstract"), 3))).alias("term"))
    n = t.join(_tops(spark, folder), "term").groupBy("work", "cluster").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    return n.groupBy("work").agg(F.count(F.lit(1)).alias("n_clusters")).where("n_clusters >= 2")


def without_query_terms(spark, folder):
    t = F.regexp_replace(F.lower("title"), r"\b(compost|glass|starch)\b", " ")
    return works(spark, folder).where("title is not null").select("work", F.md5(X.one_blank(t)).alias("digest"))


def vector_diversity(spark, folder):
    d = P.diversity(table(spark, folder, "embeddings"), "embedding", 64)
    return spark.createDataFrame([tuple(float(v) for v in d.values())], ", ".join(f"{k} double" for k in d))


def seeded_clusters(spark, folder):
    e = table(spark, folder, "embeddings")
    seeds = V.centroids(e.where("vec_id % 5 = 0"), "label", "embedding").select(F.col("group").alias("cluster"), "centroid")
    return P.seeded_kmeans(e, "vec_id", "embedding", seeds, 4)


def walk_lengths(spark, folder):
    w = works(spark, folder).select("work", F.explode("concepts").alias("c"))
    walks = P.uniform_walks(G.shared_hub_pairs(w, "work", "c", least=4), 6, 2)
    return walks.groupBy(F.size("path").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(F.array_distinct("path"))).alias("distinct_nodes"))


def open_access_logit(spark, folder):
    w = works(spark, folder).where("is_oa is not null").withColumn("n_authors", F.size("authors")).withColumn("cited", F.log1p("citations"))
    return P.logit(w, "is_oa", ["n_authors", "cited"], ["type"])


QUERIES = {f.__name__: f for f in (
    cross_cutting, relevance, junk_labels, numeric_names, running_index, same_features, threshold_overlap, region_paths, neighbours_by_type, most_complete, concepts_as_text, stable_extremes,
    term_likeness, best_candidates, aligned_pairs, community_ranking, bridge_works, without_query_terms, vector_diversity, seeded_clusters, walk_lengths, open_access_logit)}

_W = "WITH " + WORKS_SQL
_b = lambda c: rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_cat = "coalesce(lower(trim(category)), '?')"
_hits = " + ".join(f"(contains(t, '{x}'))::INT" for x in ("compost", "glass", "starch"))
_clip = lambda x: f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {x}))"
_junk = ", ".join(f"'{j}'" for j in JUNK)
_words = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z]+'))"

SQL = {
    "cross_cutting": _W + f", t AS (SELECT work, unnest(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z]+')) AS t FROM works) SELECT work, count(DISTINCT CASE {_v._cat} END) AS n FROM t GROUP BY 1 HAVING count(DISTINCT CASE {_v._cat} END) >= 2",
    "relevance": _W + f""" SELECT work, round(0.4 * {_clip('ln(1 + coalesce(citations, 0)) / 6')} + 0.2 * {_clip('(coalesce(year, 2000) - 2000) / 25')} + 0.3 * (({_hits}) / 3) + 0.1 * {_clip("length(coalesce(abstract, '')) / 1500")}, 8) AS score
        FROM (SELECT *, lower(concat_ws(' ', title, abstract)) AS t FROM works)""",
    "junk_labels": f"""SELECT DISTINCT node_id, reason FROM (SELECT node_id, CASE WHEN len(w) >= 5 THEN 'phrase' WHEN len(list_filter(w, lambda x: regexp_matches(x, '^[0-9/.]+$'))) > 0 THEN 'number'
        WHEN len(list_filter(w, lambda x: x IN ({_junk}))) > 0 THEN 'junk' END AS reason FROM (SELECT node_id, string_split(lower({_b('label')}), ' ') AS w FROM ingredients WHERE label IS NOT NULL)) WHERE reason IS NOT NULL""",
    "numeric_names": f"""WITH i AS (SELECT DISTINCT regexp_replace(translate(lower(label), '{X.ACCENTED}', '{X.FOLDED}'), '[^a-z]+', '', 'g') AS k, lower(label) AS l FROM ingredients WHERE label IS NOT NULL)
        SELECT k, count(*) AS n, count(*) FILTER (regexp_matches(l, '[0-9]')) AS m FROM i GROUP BY 1 HAVING count(*) >= 3 AND count(*) FILTER (regexp_matches(l, '[0-9]')) >= 0.5 * count(*)""",
    "running_index": """SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS "index" FROM (SELECT doc_id, coalesce(nullif(lower(trim(source)), ''), '?') AS source FROM documents)""",
    "same_features": _W + " SELECT min(work) AS work, count(*) AS n FROM works WHERE title IS NOT NULL GROUP BY lower(title), concepts",
    "threshold_overlap": """WITH t AS (SELECT t::DOUBLE AS t, candidate_id AS c FROM (SELECT DISTINCT candidate_id, sbert_cosine FROM bridge_candidates), (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t) WHERE sbert_cosine >= t), d AS (SELECT DISTINCT * FROM t), s AS (SELECT t, count(*) AS s FROM d GROUP BY 1),
        n AS (SELECT x.t AS a, y.t AS b, count(*) AS k FROM d x JOIN d y ON x.c = y.c AND x.t < y.t GROUP BY ALL) SELECT sa.t AS a, sb.t AS b, coalesce(k, 0) AS shared, round(coalesce(k, 0) / (sa.s + sb.s - coalesce(k, 0)), 8) AS jaccard FROM s sa JOIN s sb ON sa.t < sb.t LEFT JOIN n ON n.a = sa.t AND n.b = sb.t""",
    "region_paths": "SELECT s_suppkey, 'world > ' || r_name || ' > ' || n_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "neighbours_by_type": _W + " SELECT * FROM (SELECT work, 'author' AS kind, len(authors)::INT AS n FROM works UNION ALL SELECT work, 'concept', len(concepts)::INT FROM works UNION ALL SELECT work, 'reference', len(refs)::INT FROM works) WHERE n > 0",
    "most_complete": _W + """, s AS (SELECT cluster, work, ((doi IS NOT NULL)::INT + (year IS NOT NULL)::INT + coalesce((length(abstract) > 100)::INT, 0) + (len(authors) > 0)::INT + (len(concepts) > 2)::INT + (len(refs) > 0)::INT) AS score, coalesce(citations, 0) AS citations FROM works)
        SELECT cluster, work, score, citations FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, citations DESC, work) AS rn FROM s) WHERE rn = 1""",
    "concepts_as_text": _W + """, n AS (SELECT cluster, c, count(*) AS n FROM (SELECT cluster, unnest(concepts) AS c FROM works) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c) AS rn FROM n)
        SELECT cluster, string_agg(c || ' (' || n || ')', '; ' ORDER BY rn) AS concepts FROM r WHERE rn <= 5 GROUP BY 1""",
    "stable_extremes": _v._TOP + " SELECT a, b, sum(x)::BIGINT AS n_extreme FROM (" + " UNION ALL ".join(f"SELECT a, b, (rbo < 0.02)::INT AS x FROM ({_v._rbo(p, n)})" for p in (0.8, 0.9) for n in (5, 12)) + ") GROUP BY ALL",
    "term_likeness": f"""SELECT category, count(*) AS n, count(*) FILTER (j = 0) AS n_zero, round(avg(j), 8) AS mean FROM (SELECT {_cat} AS category, len(list_intersect({_words('term_a')}, {_words('term_b')})) / len(list_distinct(list_concat({_words('term_a')}, {_words('term_b')}))) AS j FROM bridge_candidates) GROUP BY 1""",
    "best_candidates": f"""SELECT category, cluster_a, cluster_b, candidate_id, sbert_cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY category, cluster_a, cluster_b ORDER BY sbert_cosine DESC, candidate_id) AS place
        FROM (SELECT {_cat} AS category, cluster_a, cluster_b, candidate_id, sbert_cosine FROM bridge_candidates WHERE sbert_cosine IS NOT NULL)) WHERE place <= 2""",
    "aligned_pairs": """WITH j AS (SELECT candidate_id, count(DISTINCT nullif(lower(trim(judge)), '')) AS k FROM judgements WHERE parse_ok AND bridge_validity >= 3 GROUP BY 1), b AS (SELECT candidate_id, min((cluster_a, cluster_b)) AS x FROM bridge_candidates GROUP BY 1)
        SELECT x[1] AS cluster_a, x[2] AS cluster_b, count(*) AS n, count(*) FILTER (coalesce(k, 0) >= 2) AS n_aligned FROM b LEFT JOIN j USING (candidate_id) GROUP BY 1, 2""",
    "community_ranking": _m._T + """, s AS (SELECT q.id AS query, t.id AS doc, count(*) AS score FROM q JOIN t USING (term) JOIN works a ON a.work = q.id JOIN works b ON b.work = t.id WHERE q.id <> t.id AND a.cluster = b.cluster GROUP BY ALL)
        SELECT query, doc, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM s) WHERE place <= 5""",
    "bridge_works": _v._TOP + """, d AS (SELECT DISTINCT work, term FROM (SELECT work, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z]+'), lambda w: length(w) >= 3)) AS term FROM works)),
        n AS (SELECT work, cluster FROM d JOIN tops USING (term) GROUP BY ALL HAVING count(*) >= 2) SELECT work, count(*) AS n_clusters FROM n GROUP BY 1 HAVING count(*) >= 2""",
    "without_query_terms": _W + " SELECT work, md5(" + _b(r"regexp_replace(lower(title), '\b(compost|glass|starch)\b', ' ', 'g')") + ") AS digest FROM works WHERE title IS NOT NULL",
}
