"""Queries over clusters' vocabularies and flows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null
from quire.operators import graph as G
from quire.operators import relational as R
from quire.operators import vocabulary as V
from quire.plans.text_queries import STOP
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works

N_TOP = 12


def _counts(spark, folder):
    w = works(spark, folder).select("work", "cluster", X.words(F.concat_ws(" ", "title", "abstract"), 3, STOP).alias("terms"))
    return V.term_counts(w, "work", "cluster", "terms")


def _tops(spark, folder):
    return V.top_terms(V.class_tf_idf(_counts(spark, folder)), N_TOP)


def _flows(spark, folder):
    w = works(spark, folder)
    return G.labelled(citations(w), w, "work", "cluster")


def _r(df, *cols, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def class_topics(spark, folder):
    return _tops(spark, folder)


def binary_topics(spark, folder):
    """Top terms by ln(N / (df + 1)) of the clusters that have the term, of terms in at least three."""
    c = _counts(spark, folder)
    n = c.select("cluster").distinct().agg(F.count(F.lit(1)).alias("n_clusters"))
    df = c.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df >= 3")
    w = c.join(df, "term").crossJoin(F.broadcast(n)).select("cluster", "term", (F.col("n_docs") * F.log(F.col("n_clusters") / (F.col("df") + 1))).alias("weight"))
    return V.top_terms(w, N_TOP)


def doc_weights(spark, folder):
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", X.words("text", 3, STOP).alias("terms"))
    return R.top_per_group(V.doc_tf_idf(d, "doc_id", "terms"), ["doc"], [F.desc(F.round("weight", 10)), F.asc("term")], 3).select("doc", "term", F.round("weight", 8).alias("weight"))


def topic_jaccard(spark, folder):
    return _r(V.vocabulary_jaccard(_tops(spark, folder)), "jaccard")


def topic_rbo(spark, folder):
    return _r(V.rank_biased_overlap(_tops(spark, folder)), "rbo")


def rbo_sensitivity(spark, folder):
    tops = _tops(spark, folder)
    out = None
    for p in (0.8, 0.9, 0.95):
        for n in (5, 12):
            one = V.rank_biased_overlap(tops, p, n).agg(F.round(F.avg(1 - F.col("rbo")), 8).alias("mean"), F.round(F.min(1 - F.col("rbo")), 8).alias("least"), F.count_if(F.col("rbo") > 0.1).alias("n_above"))
            one = one.select(F.lit(p).alias("p"), F.lit(n).alias("depth"), "mean", "least", "n_above")
            out = one if out is None else out.union(one)
    return out


def topic_js(spark, folder):
    return _r(V.js_distances(_counts(spark, folder)), "distance")


def cross_share(spark, folder):
    return _r(V.cross_share(_flows(spark, folder)), "s_cross")


def cross_flows(spark, folder):
    return V.flow(_flows(spark, folder))


def incidence_share(spark, folder):
    return _r(V.incidence_share(_flows(spark, folder)), "s_cross")


def cohesion(spark, folder):
    f = _flows(spark, folder)
    return _r(V.cohesion_score(V.js_distances(_counts(spark, folder)), V.flow(f), V.cross_share(f)), "d_mean", "d_weighted", "s_cross", "csc", digits=7)


def threshold_sweep(spark, folder):
    return V.threshold_sweep(table(spark, folder, "bridge_candidates"), "sbert_cosine", [0.5, 0.6, 0.7, 0.8])


def diversity(spark, folder):
    n = works(spark, folder).where("cluster is not null").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    p = n.select("cluster", (F.col("n") / F.sum("n").over(R.Window.partitionBy())).alias("p"))
    return _r(V.rao_stirling(p, V.js_distances(_counts(spark, folder))), "rao_stirling", digits=7)


def distinctive_concepts(spark, folder):
    w = works(spark, folder).select("cluster", "work", F.explode_outer("concepts").alias("concept"))
    return _r(V.distinctive(w, "cluster", "work", "concept"), "share", "lift", digits=7)


def source_dominance(spark, folder):
    d = table(spark, folder, "documents").select(F.coalesce(F.lower(blank_to_null("lang")), F.lit("?")).alias("lang"), F.coalesce(F.lower(blank_to_null("source")), F.lit("?")).alias("source"))
    return _r(V.dominance(d, "lang", "source"), "top_share")


def type_separation(spark, folder):
    return _r(V.separation(works(spark, folder), "cluster", "type", "article", "preprint"), "share_apart")


def type_entropy(spark, folder):
    return _r(V.entropies(works(spark, folder), "cluster", "type"), "entropy")


CATEGORIES = {1: ["compost", "sludge", "husk"], 2: ["glass", "clay", "mortar"], 3: ["starch", "dough", "bran"]}


def keyword_labels(spark, folder):
    w = works(spark, folder).select("work", F.explode(X.words(F.concat_ws(" ", "title", "abstract"), 3)).alias("t"))
    m = F.coalesce(*(F.when(F.col("t").isin(*v), k) for k, v in CATEGORIES.items()))
    hits = w.select(F.col("work").alias("doc"), m.alias("category")).where("category is not null").groupBy("doc", "category").agg(F.count(F.lit(1)).alias("hits"))
    return V.keyword_labels(hits).withColumn("label", F.col("label").cast("int"))


def cluster_trends(spark, folder):
    n = works(spark, folder).where("year is not null and cluster is not null").groupBy(F.col("cluster").alias("group"), "year").agg(F.count(F.lit(1)).alias("n"))
    return _r(V.trends(n), "slope", "r2", "autocorr1", digits=7)


def observed_windows(spark, folder):
    w = works(spark, folder).where("year is not null").select("work", "year", "citations")
    return R.observed_windows(w, "year", 3).join(w, "year").groupBy("start", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("citations").alias("citations")).where("n >= 5")


def cluster_summary(spark, folder):
    w = works(spark, folder).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("citations"), 8).alias("mean_citations"), F.max("year").alias("last"))
    kind = F.when((F.col("mean_citations") >= 20) & (F.col("n") >= 100), "mature").when(F.col("n") < 60, "niche").otherwise("mixed")
    return w.withColumn("archetype", kind)


QUERIES = {f.__name__: f for f in (
    class_topics, binary_topics, doc_weights, topic_jaccard, topic_rbo, rbo_sensitivity, topic_js, cross_share, cross_flows, incidence_share, cohesion, threshold_sweep, diversity,
    distinctive_concepts, source_dominance, type_separation, type_entropy, keyword_labels, cluster_trends, observed_windows, cluster_summary)}

_stop = ", ".join(f"'{s}'" for s in STOP)
_W = "WITH " + WORKS_SQL
_N = _W + f""", t0 AS (SELECT cluster, work, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_stop}))) AS term FROM works WHERE cluster IS NOT NULL),
    cnt AS (SELECT cluster, term, count(*) AS n, count(DISTINCT work) AS n_docs FROM t0 GROUP BY ALL)"""
_TOP = _N + f""", w AS (SELECT cluster, term, n / sum(n) OVER (PARTITION BY cluster) * ln(1 + (SELECT count(DISTINCT cluster) FROM cnt) / (count(*) OVER (PARTITION BY term) + 1)) AS weight, count(*) OVER (PARTITION BY term) AS df FROM cnt),
    tops AS (SELECT cluster, term, place FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 12) DESC, term) AS place FROM w WHERE df >= 2) WHERE place <= {N_TOP}), sz AS (SELECT cluster, count(*) AS s FROM tops GROUP BY 1),
    pr AS (SELECT a.cluster AS a, b.cluster AS b, least(a.s, b.s) AS hi, a.s + b.s AS ss FROM sz a JOIN sz b ON a.cluster < b.cluster)"""
_rbo = lambda p, n: f"""SELECT pr.a, pr.b, (1 - {p}) * coalesce(sum({p} ** (d - 1) * k / d), 0) AS rbo FROM pr LEFT JOIN (SELECT a, b, d, count(*) AS k FROM (SELECT x.cluster AS a, y.cluster AS b, greatest(x.place, y.place) AS lo FROM tops x JOIN tops y ON x.term = y.term AND x.cluster < y.cluster),
    range(1, {n} + 1) r(d) WHERE lo <= d GROUP BY ALL) q ON q.a = pr.a AND q.b = pr.b AND d <= hi GROUP BY 1, 2"""  # noqa: E731
_JS = """, sh AS (SELECT cluster, term, n / sum(n) OVER (PARTITION BY cluster) AS p FROM cnt), cl AS (SELECT DISTINCT cluster FROM cnt),
    full_ AS (SELECT x.cluster AS a, y.cluster AS b, t.term, coalesce(p.p, 0) AS p, coalesce(q.p, 0) AS q FROM cl x JOIN cl y ON x.cluster < y.cluster, (SELECT DISTINCT term FROM cnt) t LEFT JOIN sh p ON p.cluster = x.cluster AND p.term = t.term LEFT JOIN sh q ON q.cluster = y.cluster AND q.term = t.term),
    js AS (SELECT a, b, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance FROM full_ GROUP BY a, b)"""
_lab = ", " + CITATIONS_SQL + ", lab AS (SELECT s.cluster AS sl, d.cluster AS dl FROM cites JOIN works s ON s.work = src JOIN works d ON d.work = dst WHERE s.cluster IS NOT NULL AND d.cluster IS NOT NULL)"
_cat = " ".join(f"WHEN t IN ({', '.join(repr(x) for x in v)}) THEN {k}" for k, v in CATEGORIES.items())
_rss = "count(*) * (var_pop(n) - coalesce(covar_pop(year, n) ** 2 / nullif(var_pop(year), 0), 0))"

SQL = {
    "class_topics": _TOP + " SELECT * FROM tops",
    "binary_topics": _N + f""", w AS (SELECT cluster, term, n_docs * ln((SELECT count(DISTINCT cluster) FROM cnt) / (count(*) OVER (PARTITION BY term) + 1)) AS weight, count(*) OVER (PARTITION BY term) AS df FROM cnt)
        SELECT cluster, term, place FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 12) DESC, term) AS place FROM w WHERE df >= 3) WHERE place <= {N_TOP}""",
    "doc_weights": f"""WITH tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc_id AS doc, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_stop}))) AS term FROM documents) GROUP BY ALL),
        n AS (SELECT count(*) AS N FROM documents WHERE text IS NOT NULL), x AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf), r AS (SELECT doc, term, tf * (ln((1 + N) / (1 + df)) + 1) AS w FROM x, n WHERE df >= 2 AND df <= 0.95 * N),
        u AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM r)
        SELECT doc, term, round(weight, 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 10) DESC, term) AS rn FROM u) WHERE rn <= 3""",
    "topic_jaccard": _TOP + """, sd AS (SELECT x.cluster AS a, y.cluster AS b, count(*) AS k FROM tops x JOIN tops y ON x.term = y.term AND x.cluster < y.cluster GROUP BY ALL)
        SELECT a, b, coalesce(k, 0) AS shared, round(coalesce(k, 0) / (ss - coalesce(k, 0)), 8) AS jaccard FROM pr LEFT JOIN sd USING (a, b)""",
    "topic_rbo": _TOP + " SELECT a, b, round(rbo, 8) AS rbo FROM (" + _rbo(0.9, N_TOP) + ")",
    "rbo_sensitivity": _TOP + " " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS p, {n} AS depth, round(avg(1 - rbo), 8) AS mean, round(min(1 - rbo), 8) AS least, count(*) FILTER (rbo > 0.1) AS n_above FROM ({_rbo(p, n)})" for p in (0.8, 0.9, 0.95) for n in (5, 12)),
    "topic_js": _N + _JS + " SELECT a, b, round(distance, 8) AS distance FROM js",
    "cross_share": _W + _lab + " SELECT count(*) AS n_edges, count(*) FILTER (sl <> dl) AS n_cross, round(count(*) FILTER (sl <> dl) / count(*), 8) AS s_cross FROM lab",
    "cross_flows": _W + _lab + " SELECT least(sl, dl) AS a, greatest(sl, dl) AS b, count(*) AS n FROM lab WHERE sl <> dl GROUP BY ALL",
    "incidence_share": _W + _lab + " SELECT total, intra, round((total - intra) / total, 8) AS s_cross FROM (SELECT sum(CASE WHEN sl = dl THEN 1 ELSE 2 END)::BIGINT AS total, count(*) FILTER (sl = dl) AS intra FROM lab)",
    "cohesion": _N + _JS + _lab + """, fl AS (SELECT least(sl, dl) AS a, greatest(sl, dl) AS b, count(*) AS n FROM lab WHERE sl <> dl GROUP BY ALL), d AS (SELECT avg(distance) AS d_mean, sum(distance * coalesce(n, 0)) / sum(coalesce(n, 0)) AS d_weighted FROM js LEFT JOIN fl USING (a, b)),
        s AS (SELECT count(*) FILTER (sl <> dl) / count(*) AS s_cross FROM lab) SELECT round(d_mean, 7) AS d_mean, round(d_weighted, 7) AS d_weighted, round(s_cross, 7) AS s_cross, round(1 - s_cross * d_weighted, 7) AS csc FROM d, s""",
    "threshold_sweep": "SELECT t::DOUBLE AS threshold, count(*) FILTER (sbert_cosine >= t) AS n_at_least, count(*) FILTER (sbert_cosine BETWEEN t * 0.9::DOUBLE AND t * 1.1::DOUBLE) AS n_near FROM bridge_candidates, (SELECT unnest([0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t) GROUP BY t",
    "diversity": _N + _JS + ", p AS (SELECT cluster, count(*) / sum(count(*)) OVER () AS p FROM works WHERE cluster IS NOT NULL GROUP BY 1) SELECT round(2 * sum(distance * x.p * y.p), 7) AS rao_stirling FROM js JOIN p x ON x.cluster = a JOIN p y ON y.cluster = b",
    "distinctive_concepts": _W + """, m AS (SELECT cluster, work, unnest(concepts) AS item FROM works WHERE cluster IS NOT NULL), s AS (SELECT cluster, count(*) AS size, sum(count(*)) OVER () AS tot FROM works WHERE cluster IS NOT NULL GROUP BY 1),
        n AS (SELECT cluster, item, count(*) AS n FROM m GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY item) AS e FROM n JOIN s USING (cluster))
        SELECT cluster, item, n, round(n / size, 7) AS share, round((n / size) / ((e - n) / (tot - size) + 0.001), 7) AS lift FROM x WHERE n / size >= 0.05""",
    "source_dominance": """WITH n AS (SELECT coalesce(nullif(lower(trim(lang)), ''), '?') AS cluster, coalesce(nullif(lower(trim(source)), ''), '?') AS source, count(*) AS k FROM documents GROUP BY 1, 2)
        SELECT cluster, sum(k)::BIGINT AS n, count(*) AS n_sources, first(source ORDER BY k DESC, source) AS top_source, round(max(k) / sum(k), 8) AS top_share FROM n GROUP BY 1""",
    "type_separation": _W + """, x AS (SELECT cluster, type FROM works), p AS (SELECT count(*) FILTER (type = 'article') * count(*) FILTER (type = 'preprint') AS pairs FROM x),
        s AS (SELECT sum(a * b)::BIGINT AS same FROM (SELECT count(*) FILTER (type = 'article') AS a, count(*) FILTER (type = 'preprint') AS b FROM x GROUP BY cluster)) SELECT pairs, pairs - same AS apart, round(1 - same / pairs, 8) AS share_apart FROM p, s""",
    "type_entropy": _W + ', n AS (SELECT cluster, type, count(*) AS k FROM works WHERE type IS NOT NULL GROUP BY ALL) SELECT cluster AS "group", sum(k)::BIGINT AS n, round(-sum(p * ln(p)), 8) AS entropy FROM (SELECT *, k / sum(k) OVER (PARTITION BY cluster) AS p FROM n) GROUP BY 1',
    "keyword_labels": _W + f""", t AS (SELECT work AS doc, unnest(list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z]+'), lambda w: length(w) >= 3)) AS t FROM works), h AS (SELECT doc, CASE {_cat} END AS c, count(*) AS k FROM t GROUP BY ALL),
        r AS (SELECT doc, first(c ORDER BY k DESC, c) AS c, max(k) / sum(k) AS s FROM h WHERE c IS NOT NULL GROUP BY doc) SELECT doc, CASE WHEN s >= 0.5 THEN c ELSE -1 END AS label FROM r""",
    "cluster_trends": _W + f""", c AS (SELECT cluster AS g, year, count(*) AS n FROM works WHERE year IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL), f AS (SELECT g, count(*) AS n_years, regr_slope(n, year) AS slope, regr_r2(n, year) AS r2, regr_r2(ln(n + 1), year) AS r2e, avg(n) AS mean, {_rss} AS rss FROM c GROUP BY g),
        l AS (SELECT g, sum((n - mean) * (b - mean)) / sum((n - mean) ** 2) AS ac FROM (SELECT *, lag(n) OVER (PARTITION BY g ORDER BY year) AS b FROM c) JOIN f USING (g) GROUP BY g),
        s AS (SELECT c.g, k.year AS cut, c.year < k.year AS early, count(*) AS m, count(*) * (var_pop(c.n) - coalesce(covar_pop(c.year, c.n) ** 2 / nullif(var_pop(c.year), 0), 0)) AS rss2 FROM c JOIN c k ON c.g = k.g GROUP BY ALL),
        t AS (SELECT g, cut, sum(rss2) AS rss2 FROM (SELECT s.g, s.cut, s.m, s.rss2 FROM s) GROUP BY g, cut HAVING min(m) >= 2 AND count(*) = 2), b AS (SELECT g, first(cut ORDER BY round(rss2, 8), cut) AS cut, min(round(rss2, 8)) AS rss2 FROM t GROUP BY g)
        SELECT g AS "group", n_years, round(slope, 7) AS slope, round(r2, 7) AS r2, round(ac, 7) AS autocorr1, CASE WHEN r2e > r2 + 0.1 THEN 'exponential' ELSE 'linear' END AS growth_model, CASE WHEN b.rss2 < 0.8 * rss THEN cut END AS break_year FROM f JOIN l USING (g) LEFT JOIN b USING (g)""",
    "observed_windows": _W + """, y AS (SELECT DISTINCT year FROM works WHERE year IS NOT NULL), r AS (SELECT year AS s, lead(year, 2) OVER (ORDER BY year) AS e FROM y)
        SELECT s AS "start", e AS "end", count(*) AS n, sum(citations)::BIGINT AS citations FROM r JOIN works ON year BETWEEN s AND e WHERE e IS NOT NULL GROUP BY ALL HAVING count(*) >= 5""",
    "cluster_summary": _W + """, c AS (SELECT cluster, count(*) AS n, round(avg(citations), 8) AS mean_citations, max(year) AS last FROM works GROUP BY 1)
        SELECT *, CASE WHEN mean_citations >= 20 AND n >= 100 THEN 'mature' WHEN n < 60 THEN 'niche' ELSE 'mixed' END AS archetype FROM c""",
}
