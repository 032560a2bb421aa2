"""Queries over graphs of works, authors and concepts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators.relational import top_per_group
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works


def _authors(w):
    return w.select("work", "year", "citations", "cluster", F.explode("authors").alias("author"))


def _cites(spark, folder):
    w = works(spark, folder)
    return w, G.labelled(citations(w), w, "work", "cluster")


def coauthor_edges(spark, folder):
    n = G.shared_hub_pairs(_authors(works(spark, folder)), "work", "author")
    return n.withColumn("strength", F.when(F.col("n") >= 10, "strong").when(F.col("n") >= 5, "medium").otherwise("weak"))


def strong_collaborations(spark, folder):
    return coauthor_edges(spark, folder).where("n >= 3").select("a", "b", "n")


def collaboration_degrees(spark, folder):
    return G.degrees(coauthor_edges(spark, folder)).select("id", "degree", "weighted", F.round("centrality", 10).alias("centrality"))


def cocitation_edges(spark, folder):
    return G.shared_hub_pairs(citations(works(spark, folder)), "src", "dst", least=3)


def coupling_edges(spark, folder):
    """Works that share at least three references, references cited by more than 200 works skipped."""
    return G.shared_hub_pairs(citations(works(spark, folder)), "dst", "src", least=3, largest_hub=200)


def similar_topics(spark, folder):
    """Works whose concepts have a Jaccard similarity of at least 0.3, all concepts taken."""
    c = works(spark, folder).select("work", F.explode("concepts").alias("c"))
    return G.similar_sets(c, "work", "c", 0.3).withColumn("jaccard", F.round("jaccard", 8))


def author_citation_paths(spark, folder):
    """Authors whose works are cited together: author, work, co-cited work, author."""
    w = works(spark, folder)
    pairs = cocitation_edges(spark, folder).select(F.col("a").alias("x"), F.col("b").alias("y"))
    a = _authors(w).select("work", "author")
    hop = pairs.union(pairs.select("y", "x")).join(a.select(F.col("work").alias("x"), F.col("author").alias("author_a")), "x").join(a.select(F.col("work").alias("y"), F.col("author").alias("author_b")), "y")
    return hop.where("author_a < author_b").groupBy("author_a", "author_b").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def topic_experts(spark, folder):
    x = works(spark, folder).select(F.explode("authors").alias("author"), "concepts").select("author", F.explode("concepts").alias("concept"))
    n = x.groupBy("author", "concept").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return n.withColumn("level", F.when(F.col("n") >= 10, "expert").when(F.col("n") >= 5, "advanced").otherwise("regular"))


def h_index(spark, folder):
    """An author's works are counted by citations first, so that the author of most works is no large group."""
    x = _authors(works(spark, folder)).groupBy("author", F.coalesce("citations", F.lit(0)).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    upto = x.withColumn("upto", F.sum("k").over(Window.partitionBy("author").orderBy(F.desc("c"))))
    h = F.max(F.greatest(F.lit(0), F.least("c", "upto"))).cast("int")
    return upto.groupBy("author").agg(h.alias("h"), F.sum("k").alias("n"))


def career_spans(spark, folder):
    x = _authors(works(spark, folder)).where("year is not null").groupBy("author").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return x.withColumn("per_year", F.round(F.col("n") / (F.col("last") - F.col("first") + 1), 8))


def citation_edges(spark, folder):
    w = works(spark, folder)
    e = w.select(F.col("work").alias("src"), F.explode("refs").alias("dst")).where("src <> dst")
    return e.join(w.select(F.col("work").alias("dst"), F.lit(True).alias("known")), "dst", "left").select("src", "dst", F.coalesce("known", F.lit(False)).alias("is_internal"))


def cluster_insularity(spark, folder):
    return G.insularity(_cites(spark, folder)[1]).withColumn("percent_internal", F.round("percent_internal", 8))


def corpus_insularity(spark, folder):
    return citation_edges(spark, folder).groupBy("is_internal").agg(F.count(F.lit(1)).alias("n"))


def cluster_modularity(spark, folder):
    return G.modularity(_cites(spark, folder)[1]).withColumn("q", F.round("q", 10))


def participation(spark, folder):
    return G.participation(_cites(spark, folder)[1]).withColumn("participation", F.round("participation", 8))


def concept_pairs(spark, folder):
    return G.shared_hub_pairs(works(spark, folder).select("work", F.explode("concepts").alias("c")), "work", "c", least=3)


def concept_centrality(spark, folder):
    return G.degrees(concept_pairs(spark, folder)).select("id", "degree", "weighted", F.round("centrality", 10).alias("centrality"))


def rare_bridges(spark, folder):
    """Works of different clusters that share at least two concepts other than the 50 of most works (ties by concept)."""
    w = works(spark, folder).select("work", "cluster", F.explode("concepts").alias("c"))
    common = w.groupBy("c").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), "c").limit(50).select("c")
    pairs = G.overlapping_sets(w.join(common, "c", "left_anti"), "work", "c", lambda s: F.lit(2), lambda n, sa, sb: n >= 2).select("a", "b", "n")
    side = lambda x: w.select(F.col("work").alias(x), F.col("cluster").alias(f"cluster_{x}")).distinct()
    return pairs.join(side("a"), "a").join(side("b"), "b").where("cluster_a <> cluster_b")


def coauthor_components(spark, folder):
    e = coauthor_edges(spark, folder).where("n >= 2").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return G.connected_components(e)


def label_merges(spark, folder):
    """Foods' other names merged into their labels, names chained, and the roots they end in."""
    t = table(spark, folder, "foodon_terms")
    base = t.select(F.col("foodon_label").alias("src"), F.element_at(F.split("foodon_label", " "), 1).alias("dst")).where("src <> dst")
    alt = t.select(F.explode("alt_labels").alias("src"), F.col("foodon_label").alias("dst")).where("src is not null")
    return G.closure(alt.union(base))


def merged_edges(spark, folder):
    """Concept pairs with the merge of each concept of odd digit sum left out: ends redirected."""
    pairs = concept_pairs(spark, folder).select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")
    roots = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().where("substring(id, -1) = '7'").select("id", F.concat(F.substring("id", 1, 8), F.lit("X")).alias("root"))
    return G.redirect(pairs, roots, [], ["n"])


def region_ancestors(spark, folder):
    """Everything above a customer or supplier: nation, region, at its depth."""
    t = lambda n: table(spark, folder, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = (
        t("supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"))
        .union(t("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey")))
        .union(t("region").select(key("r", "r_regionkey"), F.lit("world")))
    )
    return G.ancestors(e)


def ancestor_coverage(spark, folder):
    a = region_ancestors(spark, folder).where("id like 's%'")
    return a.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


def usage_by_period(spark, folder):
    w = works(spark, folder).where("year is not null").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    total = w.groupBy("decade").agg(F.count(F.lit(1)).alias("total"))
    n = w.select("decade", F.explode("concepts").alias("concept")).groupBy("decade", "concept").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("concept").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "concept").limit(40).select("concept")
    return n.join(top, "concept", "left_semi").join(total, "decade").select("decade", "concept", "n", F.round(100 * F.col("n") / F.col("total"), 8).alias("percent"))


def profile_by_language(spark, folder):
    w = works(spark, folder).where("language is not null")
    many = w.groupBy("language").agg(F.count(F.lit(1)).alias("total")).where("total >= 5")
    n = w.select("language", F.explode("concepts").alias("concept")).groupBy("language", "concept").agg(F.count(F.lit(1)).alias("n")).join(many, "language")
    return top_per_group(n.select("language", "concept", "n", F.round(100 * F.col("n") / F.col("total"), 8).alias("percent")), ["language"], [F.desc("n"), F.asc("concept")], 10)


def graph_counts(spark, folder):
    w = works(spark, folder)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("what"), "n")
    return (
        one(w, "works").union(one(w.select(F.explode("authors")).distinct(), "authors")).union(one(w.select(F.explode("concepts")).distinct(), "concepts"))
        .union(one(citations(w), "citations")).union(one(w.select("work", F.explode("authors")), "authored"))
    )


def graph_invariants(spark, folder):
    w = works(spark, folder)
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("check"), "n")
    alone = w.select("work").join(citations(w).select(F.explode(F.array("src", "dst")).alias("work")).distinct(), "work", "left_anti")
    return one(w.where("size(authors) = 0"), "work without author").union(one(w.where("size(concepts) = 0"), "work without concept")).union(one(alone, "work without citation"))


def pagerank(spark, folder):
    return G.pagerank(citations(works(spark, folder)))


def eigenvector(spark, folder):
    return G.eigenvector_centrality(concept_pairs(spark, folder))


def concept_communities(spark, folder):
    return G.label_communities(concept_pairs(spark, folder))


def louvain_communities(spark, folder):
    return G.louvain(concept_pairs(spark, folder))



QUERIES = {f.__name__: f for f in (
    coauthor_edges, strong_collaborations, collaboration_degrees, cocitation_edges, coupling_edges, similar_topics, author_citation_paths, topic_experts, h_index, career_spans,
    citation_edges, cluster_insularity, corpus_insularity, cluster_modularity, participation, concept_pairs, concept_centrality, rare_bridges, coauthor_components, label_merges,
    merged_edges, region_ancestors, ancestor_coverage, usage_by_period, profile_by_language, graph_counts, graph_invariants, pagerank, eigenvector, concept_communities, louvain_communities)}

_W = "WITH RECURSIVE " + WORKS_SQL
_A = _W + f", au AS (SELECT * FROM (SELECT work, year, citations, cluster, unnest(authors) AS author FROM works) WHERE author <> 'A9000000000')"
_CO = _A + ", co AS (SELECT x.author AS a, y.author AS b, count(*) AS n FROM au x JOIN au y ON x.work = y.work AND x.author < y.author GROUP BY ALL)"
_C = _W + ", " + CITATIONS_SQL
_L = _C + ", lab AS (SELECT src, dst, s.cluster AS sl, d.cluster AS dl FROM cites JOIN works s ON s.work = src JOIN works d ON d.work = dst WHERE s.cluster IS NOT NULL AND d.cluster IS NOT NULL)"
_K = _W + ", k AS (SELECT work, cluster, unnest(concepts) AS c FROM works), kp AS (SELECT x.c AS a, y.c AS b, count(*) AS n FROM k x JOIN k y ON x.work = y.work AND x.c < y.c GROUP BY ALL HAVING count(*) >= 3)"
_DEG = ", d AS (SELECT id, count(*) AS degree, sum(n)::BIGINT AS weighted FROM (SELECT a AS id, n FROM {0} UNION ALL SELECT b, n FROM {0}) GROUP BY id) SELECT id, degree, weighted, round(degree / (count(*) OVER () - 1), 10) AS centrality FROM d"
_ONT = """WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
    up AS (SELECT src AS id, dst AS ancestor, 1 AS depth FROM e UNION ALL SELECT id, dst, depth + 1 FROM up JOIN e ON src = ancestor WHERE depth < 5), anc AS (SELECT id, ancestor, min(depth)::INT AS depth FROM up GROUP BY ALL)
"""

SQL = {
    "coauthor_edges": _CO + " SELECT a, b, n, CASE WHEN n >= 10 THEN 'strong' WHEN n >= 5 THEN 'medium' ELSE 'weak' END AS strength FROM co",
    "strong_collaborations": _CO + " SELECT a, b, n FROM co WHERE n >= 3",
    "collaboration_degrees": _CO + _DEG.format("co"),
    "cocitation_edges": _C + " SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM cites x JOIN cites y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL HAVING count(*) >= 3",
    "coupling_edges": _C + """, m3 AS (SELECT * FROM cites WHERE src IN (SELECT src FROM cites GROUP BY src HAVING count(*) >= 3)), m AS (SELECT * FROM m3 WHERE dst IN (SELECT dst FROM m3 GROUP BY dst HAVING count(*) <= 200))
        SELECT x.src AS a, y.src AS b, count(*) AS n FROM m x JOIN m y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 3""",
    "similar_topics": _W + """, k0 AS (SELECT work, unnest(concepts) AS c FROM works), k AS (SELECT * FROM k0 WHERE c IN (SELECT c FROM k0 GROUP BY c HAVING count(*) <= 100)), s AS (SELECT work, count(*) AS s FROM k GROUP BY 1),
        p AS (SELECT x.work AS a, y.work AS b, count(*) AS n FROM k x JOIN k y ON x.c = y.c AND x.work < y.work GROUP BY ALL)
        SELECT a, b, round(n / (sa.s + sb.s - n), 8) AS jaccard FROM p JOIN s sa ON sa.work = a JOIN s sb ON sb.work = b WHERE n / (sa.s + sb.s - n) >= 0.3""",
    "author_citation_paths": _A + ", " + CITATIONS_SQL + """, cc AS (SELECT x.dst AS x, y.dst AS y FROM cites x JOIN cites y ON x.src = y.src AND x.dst < y.dst GROUP BY ALL HAVING count(*) >= 3), bi AS (SELECT x, y FROM cc UNION ALL SELECT y, x FROM cc)
        SELECT p.author AS author_a, q.author AS author_b, count(*) AS n FROM bi JOIN au p ON p.work = x JOIN au q ON q.work = y WHERE p.author < q.author GROUP BY ALL HAVING count(*) >= 2""",
    "topic_experts": _A + """, x AS (SELECT author, unnest(concepts) AS concept FROM au JOIN works USING (work)) SELECT author, concept, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'expert' WHEN count(*) >= 5 THEN 'advanced' ELSE 'regular' END AS level
        FROM x GROUP BY 1, 2 HAVING count(*) >= 3""",
    "h_index": _A + """, r AS (SELECT author, coalesce(citations, 0) AS c, row_number() OVER (PARTITION BY author ORDER BY coalesce(citations, 0) DESC, work) AS place FROM au)
        SELECT author, coalesce(max(place) FILTER (c >= place), 0)::INT AS h, count(*) AS n FROM r GROUP BY 1""",
    "career_spans": _A + " SELECT author, min(year) AS first, max(year) AS last, count(*) AS n, round(count(*) / (max(year) - min(year) + 1), 8) AS per_year FROM au WHERE year IS NOT NULL GROUP BY 1 HAVING count(*) >= 3",
    "citation_edges": _C + " SELECT src, dst, dst IN (SELECT work FROM works) AS is_internal FROM refs_ WHERE src <> dst",
    "cluster_insularity": _L + " SELECT sl AS label, count(*) AS n_out, count(*) FILTER (sl = dl) AS n_internal, round(100 * count(*) FILTER (sl = dl) / count(*), 8) AS percent_internal FROM lab GROUP BY 1",
    "corpus_insularity": _C + " SELECT dst IN (SELECT work FROM works) AS is_internal, count(*) AS n FROM refs_ WHERE src <> dst GROUP BY 1",
    "cluster_modularity": _L + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src < dst THEN sl ELSE dl END AS la, CASE WHEN src < dst THEN dl ELSE sl END AS lb FROM lab),
        ends AS (SELECT a AS id, la AS l FROM u UNION ALL SELECT b, lb FROM u), m AS (SELECT count(*) AS m FROM u), n AS (SELECT count(DISTINCT id) AS n FROM ends)
        SELECT CASE WHEN n >= 10 THEN round(q, 10) END AS q, n AS n_nodes, m AS n_edges FROM n, m, (SELECT sum(coalesce(i.l, 0) / m - (d.d / (2 * m)) ** 2) AS q FROM (SELECT l AS k, count(*) AS d FROM ends GROUP BY 1) d
        LEFT JOIN (SELECT la AS k, count(*) AS l FROM u WHERE la = lb GROUP BY 1) i USING (k), m)""",
    "participation": _L + " SELECT src AS id, round(1 - sum(k * k) / sum(k) ** 2, 8) AS participation FROM (SELECT src, dl, count(*) AS k FROM lab GROUP BY ALL) GROUP BY 1",
    "concept_pairs": _K + " SELECT a, b, n FROM kp",
    "concept_centrality": _K + _DEG.format("kp"),
    "rare_bridges": _K + """, r AS (SELECT * FROM k WHERE c IN (SELECT c FROM k GROUP BY c HAVING count(*) <= 30))
        SELECT x.work AS a, y.work AS b, count(*) AS n, x.cluster AS cluster_a, y.cluster AS cluster_b FROM r x JOIN r y ON x.c = y.c AND x.work < y.work WHERE x.cluster <> y.cluster GROUP BY ALL HAVING count(*) >= 2""",
    "coauthor_components": _CO + """, e AS (SELECT a, b FROM co WHERE n >= 2), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS id, a AS r FROM bi UNION SELECT bi.b, reach.r FROM reach JOIN bi ON bi.a = reach.id)
        SELECT id, min(r) AS component FROM reach GROUP BY id""",
    "label_merges": """WITH m AS (SELECT foodon_label AS src, split_part(foodon_label, ' ', 1) AS dst FROM foodon_terms WHERE contains(foodon_label, ' ') UNION ALL SELECT unnest(alt_labels), foodon_label FROM foodon_terms)
        SELECT src AS id, split_part(dst, ' ', 1) AS root FROM m""",
    "merged_edges": _K + """, f AS (SELECT CASE WHEN right(a, 1) = '7' THEN left(a, 8) || 'X' ELSE a END AS src, CASE WHEN right(b, 1) = '7' THEN left(b, 8) || 'X' ELSE b END AS dst, n FROM kp)
        SELECT src, dst, sum(n)::BIGINT AS n FROM f WHERE src <> dst GROUP BY ALL""",
    "region_ancestors": _ONT + "SELECT * FROM anc",
    "ancestor_coverage": _ONT + "SELECT ancestor, count(*) AS n FROM anc WHERE id LIKE 's%' GROUP BY 1 HAVING count(*) >= 2",
    "usage_by_period": _W + """, w AS (SELECT year // 10 * 10 AS decade, concepts FROM works WHERE year IS NOT NULL), t AS (SELECT decade, count(*) AS total FROM w GROUP BY 1), n AS (SELECT decade, concept, count(*) AS n FROM (SELECT decade, unnest(concepts) AS concept FROM w) GROUP BY ALL),
        top AS (SELECT concept FROM n GROUP BY concept ORDER BY sum(n) DESC, concept LIMIT 40) SELECT decade, concept, n, round(100 * n / total, 8) AS percent FROM n JOIN t USING (decade) WHERE concept IN (SELECT concept FROM top)""",
    "profile_by_language": _W + """, w AS (SELECT language, concepts FROM works WHERE language IS NOT NULL), t AS (SELECT language, count(*) AS total FROM w GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT language, concept, count(*) AS n FROM (SELECT language, unnest(concepts) AS concept FROM w) GROUP BY ALL)
        SELECT language, concept, n, percent, place FROM (SELECT language, concept, n, round(100 * n / total, 8) AS percent, row_number() OVER (PARTITION BY language ORDER BY n DESC, concept) AS place FROM n JOIN t USING (language)) WHERE place <= 10""",
    "graph_counts": _C + """ SELECT 'works' AS what, count(*) AS n FROM works UNION ALL SELECT 'authors', count(DISTINCT a) FROM (SELECT unnest(authors) AS a FROM works) UNION ALL SELECT 'concepts', count(DISTINCT c) FROM (SELECT unnest(concepts) AS c FROM works)
        UNION ALL SELECT 'citations', count(*) FROM cites UNION ALL SELECT 'authored', sum(len(authors))::BIGINT FROM works""",
    "graph_invariants": _C + """ SELECT 'work without author' AS "check", count(*) AS n FROM works WHERE len(authors) = 0 UNION ALL SELECT 'work without concept', count(*) FROM works WHERE len(concepts) = 0
        UNION ALL SELECT 'work without citation', count(*) FROM works WHERE work NOT IN (SELECT src FROM cites UNION SELECT dst FROM cites)""",
}
