"""Queries that curate records, and seeded null models, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null
from quire.operators import curation as K
from quire.operators import graph as G
from quire.operators import resampling as S
from quire.operators import retrieval as Q
from quire.operators import vectors as V
from quire.operators import vocabulary as C
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works


def entity_pool(spark, folder):
    i = table(spark, folder, "ingredients")
    p = K.entity_pool(i, F.lower(blank_to_null(X.one_blank("label"))), "node_id", "n_occurrences", "ner_noise_flag")
    return p.select("entity", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.size("forms").alias("n_forms"), "is_noise")


def folded_edges(spark, folder):
    e = table(spark, folder, "bridge_candidates").select(F.col("cluster_a").alias("src"), F.col("cluster_b").alias("dst"), F.lower(F.trim("category")).alias("kind"), "sbert_cosine")
    return K.fold_edges(e, ["kind"], "sbert_cosine").select("src", "dst", "kind", "n_mentions", "confidence", F.size("confidences").alias("n_confidences"))


def contained_terms(spark, folder):
    i = table(spark, folder, "ingredients").select(F.lower(X.one_blank("label")).alias("label"))
    return K.containment_pairs(i, table(spark, folder, "foodon_terms"), "label", "foodon_label")


def _proposed(spark, folder):
    b = table(spark, folder, "bridge_candidates").where("term_a <> term_b").select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), F.round("sbert_cosine", 4).alias("similarity")).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    t = table(spark, folder, "bridge_candidates").select(F.explode(F.array("term_a", "term_b")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return K.proposals(b, t)


def merge_proposals(spark, folder):
    return _proposed(spark, folder).withColumn("token_overlap", F.round("token_overlap", 8))


def proposals_by_hub(spark, folder):
    return K.by_hub(_proposed(spark, folder).where("action = 'review'"))


def proposals_read_back(spark, folder):
    return K.listed(K.by_hub(_proposed(spark, folder).where("action = 'review'")))


def paired_authors(spark, folder):
    s = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max("author_names").alias("names"), F.max("source_title").alias("title"))
    return s.select("record_id", F.explode(K.paired_lists(F.col("names"), F.regexp_replace("title", " ", ";"))).alias("p")).select("record_id", "p.a", "p.b")


def cited_mean(spark, folder):
    w = works(spark, folder)
    return K.looked_up(w, "work", F.col("refs"), w, "work", "citations").select("work", "n_found", F.round("mean", 8).alias("mean"))


def merged_concepts(spark, folder):
    one = F.transform("concepts", lambda c: F.struct(c["display_name"].alias("name"), c["score"].alias("confidence"), F.array(c["concept_id"]).alias("forms")))
    p = table(spark, folder, "papers").select(F.concat_ws("|", "openalex_id", F.col("ingested_at").cast("string"), "status").alias("row"), one.alias("items"))
    m = K.merged_items(p, "row", "items", "name", "confidence", "forms")
    return m.select(F.size("items").alias("n_items")).groupBy("n_items").agg(F.count(F.lit(1)).alias("n"))


def region_markers(spark, folder):
    w = works(spark, folder).select("work", F.explode(X.words("title", 3)).alias("t"))
    s = spark.createDataFrame([(k, m) for k, ms in MARKERS.items() for m in ms], "region int, marker string")
    return K.classified(w, "work", "t", s, 2)


MARKERS = {1: ["towards", "compost", "recovery", "residues"], 2: ["comparison", "glass", "reactor"], 3: ["revisiting", "market", "extract"]}


def shuffled_cross_share(spark, folder):
    w = works(spark, folder)
    return S.cross_share_null(citations(w), w, "work", "cluster", 20)


def null_modularity(spark, folder):
    w = works(spark, folder)
    e = G.undirected(citations(w)).join(w.where("cluster is not null").select(F.col("work").alias("a")), "a", "left_semi").join(w.where("cluster is not null").select(F.col("work").alias("b")), "b", "left_semi")
    return S.null_modularity(e, w.where("cluster is not null").select(F.col("work").alias("id"), F.col("cluster").alias("label")))


def betweenness(spark, folder):
    w = works(spark, folder).select("work", F.explode("concepts").alias("c"))
    return S.betweenness(G.shared_hub_pairs(w, "work", "c", least=4))


def stratified_works(spark, folder):
    return S.stratified(works(spark, folder).select("work", "cluster", "year"), "work", "year", 0.2)


def stability(spark, folder):
    return S.bootstrap_stability(table(spark, folder, "embeddings"), "vec_id", "embedding", 8, draws=3)


def random_recall(spark, folder):
    w = works(spark, folder)
    ids = w.select(F.col("work").alias("id"))
    truth = citations(w).select(F.col("src").alias("query"), F.col("dst").alias("doc"))
    return Q.recall_at(S.random_ranking(ids, ids, 10), truth, [10]).agg(F.count(F.lit(1)).alias("n"), F.avg("recall_10").alias("recall"))


def coverage_by_seeds(spark, folder):
    """Share of the vectors within each distance of the nearest chosen seed of any label."""
    e = table(spark, folder, "embeddings")
    seeds = V.farthest_points(e, "vec_id", "label", "embedding", 2).select(F.col("key").alias("seed"))
    s = e.join(seeds, F.col("vec_id") == F.col("seed")).select(F.col("embedding").alias("s"))
    d = e.select("vec_id", "embedding").join(F.broadcast(s)).groupBy("vec_id").agg(F.min(1 - V.cosine(F.col("embedding"), F.col("s"))).alias("d"))  # two seeds a label
    r = F.explode(F.array(*(F.lit(x / 10) for x in range(3, 11))))
    return d.select("d", r.alias("radius")).groupBy("radius").agg(F.avg((F.col("d") <= F.col("radius")).cast("int")).alias("share"))


def marker_tree(spark, folder):
    """The clusters' tree by neighbour joining over their vocabularies' distances, as one text."""
    from quire.operators.resampling import neighbour_joining
    from quire.plans.vocabulary_queries import _counts
    from quire.sources.writers import newick

    import numpy as np

    rows = C.js_distances(_counts(spark, folder)).collect()  # one row per two clusters
    names = sorted({str(x) for r in rows for x in (r.a, r.b)})
    d = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(str(r.a)), names.index(str(r.b))
        d[i, j] = d[j, i] = r.distance
    return spark.createDataFrame([(newick(neighbour_joining([f"C{n}" for n in names], d)),)], "tree string")


QUERIES = {f.__name__: f for f in (
    entity_pool, folded_edges, contained_terms, merge_proposals, proposals_by_hub, proposals_read_back, paired_authors, cited_mean, merged_concepts, region_markers, shuffled_cross_share,
    null_modularity, betweenness, stratified_works, stability, random_recall, coverage_by_seeds, marker_tree)}

_W = "WITH " + WORKS_SQL
_b = lambda c: rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_tok = lambda c: f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
_PROP = f"""WITH p AS (SELECT term_a AS a, term_b AS b, max(round(sbert_cosine, 4)) AS similarity FROM bridge_candidates WHERE term_a <> term_b GROUP BY ALL), n AS (SELECT entity, count(*) AS n FROM (SELECT term_a AS entity FROM bridge_candidates UNION ALL SELECT term_b FROM bridge_candidates) GROUP BY 1),
    x AS (SELECT p.*, na.n AS n_a, nb.n AS n_b, {_tok('a')} AS wa, {_tok('b')} AS wb, na.n > nb.n OR na.n = nb.n AND a <= b AS f FROM p JOIN n na ON na.entity = a JOIN n nb ON nb.entity = b),
    y AS (SELECT *, list_sort(wa) = list_sort(wb) AS same, len(list_filter(wa, lambda t: NOT list_contains(wb, t))) = 0 OR len(list_filter(wb, lambda t: NOT list_contains(wa, t))) = 0 AS within,
        len(list_intersect(list_distinct(wa), list_distinct(wb))) / len(list_distinct(list_concat(wa, wb))) AS j FROM x),
    prop AS (SELECT CASE WHEN f THEN a ELSE b END AS root, CASE WHEN f THEN b ELSE a END AS merged, similarity, CASE WHEN f THEN n_a ELSE n_b END AS n_root, CASE WHEN f THEN n_b ELSE n_a END AS n_merged, same AS is_anagram, within AS is_contained, round(j, 8) AS token_overlap,
        CASE WHEN same OR similarity >= 0.9 AND within THEN 'merge' WHEN j > 0 OR similarity >= 0.9 THEN 'review' ELSE 'discard' END AS action FROM y)
"""
_mark = " UNION ALL ".join(f"SELECT {k} AS region, '{m}' AS marker" for k, ms in MARKERS.items() for m in ms)

SQL = {
    "entity_pool": f"SELECT entity, count(*) AS n, round(avg(n_occurrences), 6) AS mean_confidence, count(DISTINCT node_id)::INT AS n_forms, coalesce(bool_or(ner_noise_flag), false) AS is_noise FROM (SELECT nullif(lower({_b('label')}), '') AS entity, * FROM ingredients) WHERE entity IS NOT NULL GROUP BY 1",
    "folded_edges": "SELECT cluster_a AS src, cluster_b AS dst, lower(trim(category)) AS kind, count(*) AS n_mentions, max(sbert_cosine) AS confidence, count(sbert_cosine)::INT AS n_confidences FROM bridge_candidates GROUP BY 1, 2, 3",
    "contained_terms": f"""WITH l AS (SELECT DISTINCT lower({_b('label')}) AS t FROM ingredients), a AS (SELECT t, ' ' || array_to_string({_tok('t')}, ' ') || ' ' AS w FROM l WHERE length(t) >= 4 AND len({_tok('t')}) > 0),
        b AS (SELECT DISTINCT foodon_label AS t, ' ' || array_to_string({_tok('foodon_label')}, ' ') || ' ' AS w FROM foodon_terms WHERE length(foodon_label) >= 4) SELECT a.t AS a, b.t AS b FROM a, b WHERE contains(a.w, b.w) OR contains(b.w, a.w)""",
    "merge_proposals": _PROP + "SELECT * FROM prop",
    "proposals_by_hub": _PROP + "SELECT root, count(*) AS n, max(similarity) AS most, min(similarity) AS least, string_agg(merged || ' (' || printf('%.4f', similarity) || ')', '; ' ORDER BY similarity DESC, merged) AS candidates FROM prop WHERE action = 'review' GROUP BY 1",
    "proposals_read_back": _PROP + "SELECT root, merged, similarity FROM prop WHERE action = 'review'",
    "paired_authors": """WITH s AS (SELECT record_id, string_split(max(author_names), ';') AS x, string_split(replace(max(source_title), ' ', ';'), ';') AS y FROM scopus_records GROUP BY 1)
        SELECT record_id, trim(z[1]) AS a, trim(z[2]) AS b FROM (SELECT record_id, unnest(list_zip(x[:least(len(x), len(y))], y[:least(len(x), len(y))])) AS z FROM s WHERE x IS NOT NULL AND y IS NOT NULL)""",
    "cited_mean": _W + ", r AS (SELECT work, unnest(refs) AS i FROM works) SELECT w.work, count(c.citations) AS n_found, round(avg(c.citations), 8) AS mean FROM works w LEFT JOIN r ON r.work = w.work LEFT JOIN works c ON c.work = r.i GROUP BY 1",
    "merged_concepts": f"""WITH p AS (SELECT concat_ws('|', openalex_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S'), status) AS r, concepts FROM papers), k AS (SELECT r FROM p GROUP BY r),
        n AS (SELECT r, count(DISTINCT nullif(lower({_b('c.display_name')}), '')) AS n_items FROM (SELECT r, unnest(concepts) AS c FROM p) GROUP BY r) SELECT coalesce(n_items, 0)::INT AS n_items, count(*) AS n FROM k LEFT JOIN n USING (r) GROUP BY 1""",
    "region_markers": _W + f""", t AS (SELECT DISTINCT work, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS marker FROM works), h AS (SELECT work, region, count(*) AS hits FROM t JOIN ({_mark}) USING (marker) GROUP BY ALL HAVING count(*) >= 2)
        SELECT work AS record, region, hits FROM (SELECT *, row_number() OVER (PARTITION BY work ORDER BY hits DESC, region DESC) AS rn FROM h) WHERE rn = 1""",
}
