"""Queries over vectors, rankings and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null
from quire.operators import relational as R
from quire.operators import retrieval as Q
from quire.operators import stats as S
from quire.operators import vectors as V
from quire.plans.text_queries import STOP
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works


def _emb(spark, folder):
    return table(spark, folder, "embeddings")


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def vector_health(spark, folder):
    return V.health(table(spark, folder, "abstract_vectors"), "vector", 384)


def vector_norms(spark, folder):
    return _emb(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("mean_norm"))


def centroid_matrix(spark, folder):
    return _r(V.centroid_similarities(V.centroids(_emb(spark, folder), "label", "embedding")), "cosine")


def representatives(spark, folder):
    return V.representatives(_emb(spark, folder), "vec_id", "label", "embedding", 5)


def cross_domain(spark, folder):
    return _r(V.cross_domain(_emb(spark, folder), "vec_id", "label", "embedding", 0.15), "second")


def centroid_silhouette(spark, folder):
    return _r(V.silhouette_by_centroid(_emb(spark, folder), "vec_id", "label", "embedding"), "cohesion", "silhouette")


def cluster_scatter(spark, folder):
    return _r(V.scatter(_emb(spark, folder), "label", "embedding"), "between", "within", "calinski_harabasz", digits=4)


def source_centred(spark, folder):
    e = _emb(spark, folder).withColumn("source", F.col("vec_id") % 7)
    v = V.source_centred(e, "vec_id", "source", "embedding", 0.5)
    return v.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


def exact_neighbours(spark, folder):
    """The exact five nearest vectors of those whose id is divisible by 20, against all."""
    e = _emb(spark, folder)
    return V.blocked_similarities(e, "vec_id", "embedding", 5, query=F.col("vec_id") % 20 == 0).select("a", "b", "place", F.round("cosine", 6).alias("cosine"))


def neighbour_graph(spark, folder):
    return V.mutual_edges(V.blocked_similarities(_emb(spark, folder), "vec_id", "embedding", 3)).select("a", "b", F.round("weight", 6).alias("weight"))


def label_agreement(spark, folder):
    return _r(V.rand_index(works(spark, folder).withColumn("decade", F.floor(F.col("year") / 10)), "cluster", "decade"), "ari", digits=8)


def farthest_points(spark, folder):
    return V.farthest_points(_emb(spark, folder), "vec_id", "label", "embedding", 5)


def diverse_relevant(spark, folder):
    return V.diverse_relevant(_emb(spark, folder), "vec_id", "label", "embedding", 5)


def kmeans(spark, folder):
    return V.kmeans_labels(_emb(spark, folder), "vec_id", "embedding", 8)


def _terms(spark, folder):
    """Words and neighbouring pairs of words of each work's abstract."""
    w = works(spark, folder)
    both = lambda x: F.array_distinct(F.concat(x, X.ngrams(x, 2)))
    # X.terms, but with the words bound to a variable: else they are found again for each pair
    return w, w.select(F.col("work").alias("id"), F.transform(F.array(X.words("abstract", 3, STOP)), both)[0].alias("terms"))


def _asked(t):
    return t.where(F.expr("cast(substring(id, 2) as bigint) % 20 = 0"))


def _queries_terms(spark, folder):
    w, t = _terms(spark, folder)
    return w, t, _asked(t)


def _lexical(spark, folder):
    w, t, q = _queries_terms(spark, folder)
    return w, Q.overlap_top(q, t, 10)


def _topical(spark, folder):
    c = works(spark, folder).select(F.col("work").alias("id"), F.col("concepts").alias("terms"))
    return Q.overlap_top(_asked(c), c, 10)


def _truth(w):
    return citations(w).select(F.col("src").alias("query"), F.col("dst").alias("doc")).where(F.expr("cast(substring(query, 2) as bigint) % 20 = 0"))


def lexical_ranking(spark, folder):
    return _lexical(spark, folder)[1].withColumn("score", F.col("score").cast("bigint"))


def fused_ranking(spark, folder):
    return _r(Q.fuse([_lexical(spark, folder)[1], _topical(spark, folder)], 10), "score", digits=10)


def recall(spark, folder):
    w, r = _lexical(spark, folder)
    return _r(Q.recall_at(r, _truth(w), [5, 10]), "recall_5", "recall_10", digits=8)


def precision(spark, folder):
    w, r = _lexical(spark, folder)
    same = r.join(w.select(F.col("work").alias("query"), F.col("cluster").alias("c")), "query").join(w.select(F.col("work").alias("doc"), F.col("cluster").alias("d")), "doc").where("c = d").select("query", "doc")
    return _r(Q.precision_at(r, same, 5), "precision", digits=8)


def union_of_rankings(spark, folder):
    w, r = _lexical(spark, folder)
    return _r(Q.union_recall({"lexical": r, "topical": _topical(spark, folder)}, _truth(w), 10), "lexical", "topical", "any", "gap", digits=8)


def boolean_search(spark, folder):
    _, t, q = _queries_terms(spark, folder)
    return Q.overlap_sizes(q, t)


def expanded_search(spark, folder):
    """Documents found by any term, once aligned terms of the candidates are added."""
    _, t, q = _queries_terms(spark, folder)
    b = table(spark, folder, "bridge_candidates").where("sbert_cosine >= 0.6")
    a = b.select(F.explode(X.words("term_a", 3)).alias("term"), "term_b", F.col("candidate_id").alias("order")).select("term", F.explode(X.words("term_b", 3)).alias("other"), "order").where("term <> other")
    e = Q.expanded(q.select("id", F.explode("terms").alias("term")), a)
    return Q.overlap_sizes(e.groupBy("id").agg(F.collect_set("term").alias("terms")), t)


def chi2_open_access(spark, folder):
    c = works(spark, folder).where("is_oa is not null and type is not null").groupBy(F.col("type").alias("r"), F.col("is_oa").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return _r(S.chi_square(c), "statistic", "cramers_v")


def chi2_yates(spark, folder):
    c = works(spark, folder).where("is_oa is not null").groupBy((F.size("authors") > 3).alias("r"), F.col("is_oa").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return _r(S.chi_square(c, yates=True), "statistic", "cramers_v")


def chi2_residuals(spark, folder):
    c = works(spark, folder).where("is_oa is not null and type is not null").groupBy(F.col("type").alias("r"), F.col("is_oa").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return _r(S.residuals(c), "expected", "residual")


def mann_whitney_open(spark, folder):
    return _r(S.mann_whitney(works(spark, folder), "citations", "is_oa"), "u", "z")


def correlations(spark, folder):
    return _r(S.correlations(works(spark, folder).withColumn("n_authors", F.size("authors")), "citations", "n_authors"), "pearson", "spearman")


def _judged(spark, folder):
    j = table(spark, folder, "judgements").where("parse_ok and bridge_validity between 1 and 5").groupBy("candidate_id").pivot("judge", ["atlas-judge", "borea-judge"]).agg(F.max("bridge_validity"))
    return j.select("candidate_id", F.col("atlas-judge").alias("a"), F.col("borea-judge").alias("b"))


def wilcoxon_judges(spark, folder):
    return _r(S.wilcoxon(_judged(spark, folder), "a", "b"), "w_plus", "z")


def paired_judges(spark, folder):
    return _r(S.paired_t(_judged(spark, folder), "a", "b"), "mean", "t", "cohens_d")


def kappa_judges(spark, folder):
    return _r(S.kappa(_judged(spark, folder), "a", "b"), "agreement", "kappa")


def rank_ties(spark, folder):
    return R.average_ranks(works(spark, folder).where("citations is not null").select("cluster", "work", "citations"), "citations", ["cluster"], descending=True)


def bootstrap_citations(spark, folder):
    return S.bootstrap_mean(works(spark, folder), "citations")


QUERIES = {f.__name__: f for f in (
    vector_health, vector_norms, centroid_matrix, representatives, cross_domain, centroid_silhouette, cluster_scatter, source_centred, exact_neighbours, neighbour_graph, label_agreement,
    farthest_points, diverse_relevant, kmeans, lexical_ranking, fused_ranking, recall, precision, union_of_rankings, boolean_search, expanded_search, chi2_open_access, chi2_yates, chi2_residuals,
    mann_whitney_open, correlations, wilcoxon_judges, paired_judges, kappa_judges, rank_ties, bootstrap_citations)}

_W = "WITH " + WORKS_SQL
_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_cos = lambda a, b: f"{_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)})"
_CEN = """WITH el AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), cen AS (SELECT label AS g, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM el GROUP BY ALL) GROUP BY label)"""
_SIM = _CEN + f", sim AS (SELECT vec_id, label AS own, g, {_cos('embedding', 'c')} AS cosine FROM embeddings, cen)"
_stop = ", ".join(f"'{s}'" for s in STOP)
_T = _W + f""", t0 AS (SELECT DISTINCT work AS id, unnest(list_filter(regexp_extract_all(lower(title), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ({_stop}))) AS term FROM works),
    t AS (SELECT * FROM t0 WHERE term IN (SELECT term FROM t0 GROUP BY term HAVING count(*) <= 60)), q AS (SELECT * FROM t0 WHERE substr(id, 2)::BIGINT % 20 = 0),
    lex AS (SELECT query, doc, place, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT q.id AS query, t.id AS doc, count(*) AS score FROM q JOIN t USING (term) WHERE q.id <> t.id GROUP BY ALL)) WHERE place <= 10),
    c0 AS (SELECT work AS id, unnest(concepts) AS term FROM works), c AS (SELECT * FROM c0 WHERE term IN (SELECT term FROM c0 GROUP BY term HAVING count(*) <= 60)),
    top AS (SELECT query, doc, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT a.id AS query, b.id AS doc, count(*) AS score FROM c a JOIN c b USING (term) WHERE a.id <> b.id AND substr(a.id, 2)::BIGINT % 20 = 0 GROUP BY ALL)) WHERE place <= 10)"""
_TR = _T + ", " + CITATIONS_SQL + ", truth AS (SELECT src AS query, dst AS doc FROM cites WHERE substr(src, 2)::BIGINT % 20 = 0)"
_chi = lambda cells, dev: f"""{cells}, r AS (SELECT r, sum(n) AS rn FROM cells GROUP BY 1), cc AS (SELECT c, sum(n) AS cn FROM cells GROUP BY 1), tt AS (SELECT sum(n) AS t FROM cells),
    x AS (SELECT r.r, cc.c, coalesce(n, 0) AS n, rn * cn / t AS e, t FROM r CROSS JOIN cc CROSS JOIN tt LEFT JOIN cells ON cells.r = r.r AND cells.c = cc.c), s AS (SELECT sum({dev} ** 2 / e) AS s, count(DISTINCT r) AS k, count(DISTINCT c) AS m, max(t)::BIGINT AS n FROM x)
    SELECT round(s, 6) AS statistic, (k - 1) * (m - 1) AS df, n, round(sqrt(s / (n * (least(k, m) - 1))), 6) AS cramers_v FROM s"""  # noqa: E731
_OA = _W + ", cells AS (SELECT type AS r, is_oa AS c, count(*) AS n FROM works WHERE is_oa IS NOT NULL AND type IS NOT NULL GROUP BY ALL)"
_AB = """WITH j AS (SELECT candidate_id, max(bridge_validity) FILTER (judge = 'atlas-judge') AS a, max(bridge_validity) FILTER (judge = 'borea-judge') AS b FROM judgements WHERE parse_ok AND bridge_validity BETWEEN 1 AND 5 GROUP BY 1)"""
_rank = lambda v, over="": f"(rank() OVER ({over} ORDER BY {v}) + (count(*) OVER ({over + ',' if over else 'PARTITION BY'} {v}) - 1) / 2.0)"

SQL = {
    "vector_health": """SELECT count(*) FILTER (s = 'null') AS "null", count(*) FILTER (s = 'wrong_size') AS wrong_size, count(*) FILTER (s = 'not_finite') AS not_finite, count(*) FILTER (s = 'zero') AS zero, count(*) FILTER (s = 'out_of_range') AS out_of_range,
        count(*) FILTER (s = 'good') AS good FROM (SELECT CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 384 THEN 'wrong_size' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
        WHEN list_sum(list_transform(vector, lambda x: abs(x))) = 0 THEN 'zero' WHEN sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x))) NOT BETWEEN 1e-6 AND 1e6 THEN 'out_of_range' ELSE 'good' END AS s FROM abstract_vectors)""",
    "vector_norms": f"SELECT label, count(*) AS n, round(avg(sqrt({_dot('embedding', 'embedding')})), 6) AS mean_norm FROM embeddings GROUP BY 1",
    "centroid_matrix": _CEN + f" SELECT x.g AS a, y.g AS b, round({_cos('x.c', 'y.c')}, 6) AS cosine FROM cen x JOIN cen y ON x.g < y.g",
    "representatives": _SIM + ' SELECT own AS "group", vec_id, place FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY round(cosine, 9) DESC, vec_id) AS place FROM sim WHERE own = g) WHERE place <= 5',
    "cross_domain": _SIM + " SELECT vec_id, count(*) AS n_groups, round(list_sort(list(cosine), 'DESC')[2], 6) AS second FROM sim WHERE cosine >= 0.15 GROUP BY 1 HAVING count(*) >= 2",
    "centroid_silhouette": _SIM + """, x AS (SELECT vec_id, own, max(1 - cosine) FILTER (own = g) AS a, min(1 - cosine) FILTER (own <> g) AS b FROM sim GROUP BY ALL)
        SELECT own AS "group", count(*) AS n, round(avg(1 - a), 6) AS cohesion, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM x GROUP BY 1""",
    "cluster_scatter": _CEN + """, p AS (SELECT label, i, count(*) AS n, avg(x) AS m, count(*) * var_pop(x) AS w FROM el GROUP BY ALL), a AS (SELECT i, avg(x) AS mm FROM el GROUP BY 1),
        s AS (SELECT sum(n * (m - mm) ** 2) AS b, sum(w) AS w, count(DISTINCT label) AS k, sum(n) / count(DISTINCT i) AS n FROM p JOIN a USING (i)) SELECT round(b, 4) AS between, round(w, 4) AS within, round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM s""",
    "source_centred": f"""WITH u AS (SELECT vec_id, vec_id % 7 AS s, list_transform(embedding, lambda x: x::DOUBLE / sqrt({_dot('embedding', 'embedding')})) AS u FROM embeddings), c AS (SELECT s, list(m ORDER BY i) AS c FROM (SELECT s, i, avg(x) AS m FROM (SELECT s, unnest(u) AS x, unnest(range(len(u))) AS i FROM u) GROUP BY ALL) GROUP BY s),
        m AS (SELECT vec_id, list_transform(list_zip(u, c), lambda z: z[1] - 0.5 * z[2]) AS m FROM u JOIN c USING (s)) SELECT vec_id, 1.0::DOUBLE AS norm, round(m[1] / sqrt({_dot('m', 'm')}), 6) AS first FROM m""",
    "exact_neighbours": f"""SELECT a, b, place, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({_cos('x.embedding', 'y.embedding')}, 9) AS cosine FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id)) WHERE place <= 5""",
    "neighbour_graph": f"""SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(cosine), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS place FROM (SELECT x.vec_id AS a, y.vec_id AS b, round({_cos('x.embedding', 'y.embedding')}, 9) AS cosine FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id)) WHERE place <= 3 AND cosine > 0 GROUP BY 1, 2""",
    "label_agreement": _W + """, n AS (SELECT cluster AS a, year // 10 AS b, count(*) AS n FROM works WHERE cluster IS NOT NULL AND year IS NOT NULL GROUP BY ALL), c AS (SELECT sum(n * (n - 1) / 2) AS c, sum(n) AS t FROM n), r AS (SELECT sum(m * (m - 1) / 2) AS r FROM (SELECT sum(n) AS m FROM n GROUP BY a)),
        k AS (SELECT sum(m * (m - 1) / 2) AS k FROM (SELECT sum(n) AS m FROM n GROUP BY b)) SELECT round((c - r * k / (t * (t - 1) / 2)) / ((r + k) / 2 - r * k / (t * (t - 1) / 2)), 8) AS ari FROM c, r, k""",
    "lexical_ranking": _T + " SELECT * FROM lex",
    "fused_ranking": _T + """, s AS (SELECT query, doc, sum(1.0::DOUBLE / (60 + place)) AS score FROM (SELECT query, doc, place FROM lex UNION ALL SELECT * FROM top) GROUP BY ALL)
        SELECT query, doc, place, round(score, 10) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, doc) AS place FROM s) WHERE place <= 10""",
    "recall": _TR + """ SELECT query, count(*) AS n_true, count(*) FILTER (place <= 5) AS hits_5, count(*) FILTER (place <= 10) AS hits_10, round(count(*) FILTER (place <= 5) / count(*), 8) AS recall_5, round(count(*) FILTER (place <= 10) / count(*), 8) AS recall_10
        FROM truth LEFT JOIN lex USING (query, doc) GROUP BY query""",
    "precision": _T + " SELECT query, count(*) AS n_returned, round(count(*) FILTER (a.cluster = b.cluster) / count(*), 8) AS precision FROM lex JOIN works a ON a.work = query JOIN works b ON b.work = doc WHERE place <= 5 GROUP BY query",
    "union_of_rankings": _TR + """, h AS (SELECT (l.doc IS NOT NULL)::INT AS l, (p.doc IS NOT NULL)::INT AS p FROM truth LEFT JOIN lex l USING (query, doc) LEFT JOIN top p USING (query, doc))
        SELECT count(*) AS n_true, round(avg(l), 8) AS lexical, round(avg(p), 8) AS topical, round(avg(greatest(l, p)), 8) AS "any", round(avg(greatest(l, p)) - greatest(avg(l), avg(p)), 8) AS gap FROM h""",
    "boolean_search": _T + " SELECT q.id AS query, count(DISTINCT t.id) AS n_docs FROM q JOIN t USING (term) GROUP BY 1",
    "expanded_search": _T + """, b AS (SELECT term_a, term_b, candidate_id FROM bridge_candidates WHERE sbert_cosine >= 0.6), wl AS (SELECT list_filter(regexp_extract_all(lower(term_a), '[a-z]+'), lambda w: length(w) >= 3) AS x, list_filter(regexp_extract_all(lower(term_b), '[a-z]+'), lambda w: length(w) >= 3) AS y, candidate_id AS o FROM b),
        al AS (SELECT term, other, min(o) AS o FROM (SELECT term, unnest(y) AS other, o FROM (SELECT unnest(x) AS term, y, o FROM wl)) WHERE term <> other GROUP BY ALL), f AS (SELECT term, other FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY o, other) AS rn FROM al) WHERE rn <= 3),
        e AS (SELECT id, term FROM q UNION SELECT id, other FROM q JOIN f USING (term)) SELECT e.id AS query, count(DISTINCT t.id) AS n_docs FROM e JOIN t USING (term) GROUP BY 1""",
    "chi2_open_access": _chi(_OA, "abs(n - e)"),
    "chi2_yates": _chi(_W + ", cells AS (SELECT len(authors) > 3 AS r, is_oa AS c, count(*) AS n FROM works WHERE is_oa IS NOT NULL GROUP BY ALL)", "greatest(0, abs(n - e) - 0.5)"),
    "chi2_residuals": _OA + " SELECT r, c, n, round(e, 6) AS expected, round((n - e) / sqrt(e), 6) AS residual FROM (SELECT *, sum(n) OVER (PARTITION BY r) * sum(n) OVER (PARTITION BY c) / sum(n) OVER () AS e FROM cells)",
    "mann_whitney_open": _W + f""", v AS (SELECT citations AS v, is_oa AS f FROM works WHERE citations IS NOT NULL AND is_oa IS NOT NULL), r AS (SELECT *, {_rank('v')} AS k FROM v), ti AS (SELECT sum(t::DOUBLE ** 3 - t) AS ties FROM (SELECT count(*) AS t FROM v GROUP BY v)),
        s AS (SELECT count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(k) FILTER (f) AS r1 FROM r) SELECT n1, n2, round(r1 - n1 * (n1 + 1) / 2, 6) AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s, ti""",
    "correlations": _W + f""", v AS (SELECT citations::DOUBLE AS x, len(authors)::DOUBLE AS y FROM works WHERE citations IS NOT NULL), r AS (SELECT x, y, {_rank('x')} AS rx, {_rank('y')} AS ry FROM v) SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""",
    "wilcoxon_judges": _AB + f""", d AS (SELECT a - b AS d, abs(a - b) AS m FROM j WHERE a <> b), r AS (SELECT *, {_rank('m')} AS k FROM d), s AS (SELECT count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0)::DOUBLE AS w FROM r)
        SELECT n, CASE WHEN n >= 10 THEN round(w, 6) END AS w_plus, CASE WHEN n >= 10 THEN round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) END AS z FROM s""",
    "paired_judges": _AB + ", s AS (SELECT count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM j WHERE a IS NOT NULL AND b IS NOT NULL) SELECT n, round(m, 6) AS mean, round(m / (sd / sqrt(n)), 6) AS t, round(m / sd, 6) AS cohens_d FROM s",
    "kappa_judges": _AB + """, x AS (SELECT a, b FROM j WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS o FROM x), e AS (SELECT coalesce(sum(p.c * q.c), 0) AS s FROM (SELECT a, count(*) AS c FROM x GROUP BY 1) p JOIN (SELECT b, count(*) AS c FROM x GROUP BY 1) q ON p.a = q.b)
        SELECT n, round(o, 6) AS agreement, round((o - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""",
    "rank_ties": _W + f" SELECT cluster, work, citations, {_rank('citations DESC', 'PARTITION BY cluster').replace('cluster, citations DESC)', 'cluster, citations)')} AS rank FROM works WHERE citations IS NOT NULL",
}
