"""Queries through sources and sinks, and further measures of clusters and null models, with SQL.

The round trips write whole tables into the shared folder with the library's sinks and read them back
with its sources, so the rows that come back are compared with those of the tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null, doi_key
from quire.operators import curation as C
from quire.operators import graph as G
from quire.operators import resampling as S
from quire.operators import vectors as V
from quire.operators.relational import top_per_group
from quire.plans import curation_queries as K
from quire.plans import vocabulary_queries as T
from quire.plans.text_queries import PRACTICE, TALK
from quire.session import scratch
from quire.sources import readers as R
from quire.sources import writers as W
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


def csv_round_trip(spark, folder):
    at = scratch(spark, "csv")
    W.write_csv(works(spark, folder).select("work", "year", "citations", "doi"), at)
    return R.read_csv(spark, at, "work string, year int, citations int, doi string", ["year"])


def json_round_trip(spark, folder):
    at = scratch(spark, "jsonl")
    works(spark, folder).select("work", "concepts").write.json(at)
    return R.read_any(spark, at, "work string, concepts array<string>").select(F.explode("concepts").alias("concept")).groupBy("concept").agg(_n())


def log_round_trip(spark, folder):
    """Two halves of a table appended to one log."""
    at = scratch(spark, "log")
    b = table(spark, folder, "bridge_candidates").select("candidate_id", "category")
    for half in (0, 1):
        W.append_log(b.where(F.pmod("candidate_id", F.lit(2)) == half), at)
    return R.read_log(spark, at, "candidate_id bigint, category string", "candidate_id")


def parts_round_trip(spark, folder):
    at = scratch(spark, "parts")
    W.write_parts(works(spark, folder).select("work", "type"), at, "type")
    return spark.read.parquet(at).groupBy(F.col("type").cast("string").alias("type")).agg(_n())


def folder_round_trip(spark, folder):
    """A CSV folder per cluster, read back with the folders' names."""
    at = scratch(spark, "folders")
    works(spark, folder).where("cluster is not null").select("work", "cluster").write.partitionBy("cluster").csv(at, header=True)
    return R.read_by_folder(spark, f"{at}/*/*.csv", "work string", "part").groupBy("part").agg(_n())


def matrix_round_trip(spark, folder):
    """Citations between clusters as a wide matrix in a file, read back as pairs."""
    at = scratch(spark, "matrix")
    w = works(spark, folder)
    e = G.labelled(citations(w), w, "work", "cluster").select(F.col("src_label").cast("string").alias("cluster"), F.col("dst_label").cast("string").alias("to"))
    names = [r[0] for r in e.select("to").distinct().orderBy("to").collect()]  # one row per cluster
    W.write_csv(e.groupBy("cluster").pivot("to", names).count(), at)
    return R.read_matrix(spark, at, names)


def index_export(spark, folder):
    rows = W.index_rows(works(spark, folder))
    return rows.select(F.col("EID").alias("work"), F.col("Authors").alias("authors"), F.col("Year").alias("year"), F.col("Cited by").alias("cited"), F.col("Open Access").alias("access"), F.md5("References").alias("refs"))


def json_export(spark, folder):
    return W.summary_json(works(spark, folder).select("work", "year", "citations"))


def coerced_lists(spark, folder):
    r = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max("author_names").alias("a"))
    return r.select("record_id", F.size(R.coerced_list(F.replace("a", F.lit(";"), F.lit("|")))).alias("n_items"))


def listed_names(spark, folder):
    """The different items of each record's list, whatever their case."""
    r = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max("author_names").alias("a")).where("a is not null")
    return r.select("record_id", F.size(X.list_items("a", "[;|]")).alias("n_items"))


def filled_sources(spark, folder):
    """A hundred works, half of them with a DOI, filled up by works with an abstract."""
    w = works(spark, folder)
    return R.filled_up(w.where("doi is not null").select("work"), w.where("abstract is not null").select("work"), "work", 100)


def fallback_texts(spark, folder):
    """Each work's text: of a document, else its abstract, else its title."""
    w = works(spark, folder)
    d = table(spark, folder, "documents").select(F.upper(F.trim("paper_id")).alias("work"), F.col("text").alias("v"))
    out = R.coalesced(w.select("work"), "work", [("document", d), ("abstract", w.select("work", F.col("abstract").alias("v"))), ("title", w.select("work", F.col("title").alias("v")))], "v")
    return out.select("work", F.md5("v").alias("digest"), "origin")


def rebuilt_titles(spark, folder):
    """Titles out of maps of their words and places."""
    w = works(spark, folder).select("work", X.one_blank("title").alias("t")).where("t <> ''")
    words = F.split("t", " ")
    places = F.map_from_entries(F.transform(F.array_distinct(words), lambda x: F.struct(x, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i) == x))))
    return w.select("work", X.rebuilt(places).alias("title"))


def reconciled_proposals(spark, folder):
    """Every proposal for review with the candidates' decision, the others unknown."""
    asked = K.merge_proposals(spark, folder).where("action = 'review'").select("root", "merged")
    answers = table(spark, folder, "bridge_candidates").where("sbert_cosine >= 0.6").select(F.col("term_a").alias("root"), F.col("term_b").alias("merged"), F.col("candidate_id").alias("at"), F.coalesce("category", F.lit(" none ")).alias("decision"))
    return C.reconciled(asked, answers)


def edges_without_flagged(spark, folder):
    """Citations between works that aren't flagged, by what the works' titles lack."""
    w = works(spark, folder)
    nodes = w.select(F.col("work").alias("id"), "title", "year")
    keep, e = C.flagged_without(nodes, citations(w), F.col("title").isNull() | F.col("year").isNull())
    return keep.agg(_n()).select(F.lit("works").alias("what"), "n").union(e.agg(_n()).select(F.lit("citations"), "n"))


def close_vectors(spark, folder):
    """All pairs of vectors of some cosine similarity, each pair of blocks in one task."""
    return V.pairs_above(table(spark, folder, "embeddings"), "vec_id", "embedding", 0.3).select("a", "b", F.round("cosine", 6).alias("cosine"))


def davies_bouldin(spark, folder):
    """How far the labels' vectors scatter for the distance of their centres: the mean of each label's worst."""
    e = table(spark, folder, "embeddings").select("label", F.col("embedding").alias("v"))
    c = V.centroids(e, "label", "v").select(F.col("group").alias("label"), "centroid")
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    s = e.join(c, "label").groupBy("label").agg(F.avg(far(F.col("v"), F.col("centroid"))).alias("s")).join(c, "label")
    pair = s.alias("x").join(s.alias("y"), F.col("x.label") != F.col("y.label"))  # one row per two labels
    worst = pair.groupBy("x.label").agg(F.max((F.col("x.s") + F.col("y.s")) / far(F.col("x.centroid"), F.col("y.centroid"))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def large_centroids(spark, folder):
    """Centres of the labels that have ten vectors at least, by length."""
    c = V.centroids(table(spark, folder, "embeddings"), "label", "embedding", 10)
    return c.select(F.col("group").alias("label"), "n", F.round(V.norm(F.col("centroid")), 6).alias("length"))


def sublinear_topics(spark, folder):
    """Clusters' ten terms of greatest weight, counts taken by their logarithm."""
    c = T._counts(spark, folder)
    n = c.select("cluster").distinct().agg(F.count(F.lit(1)).alias("c"))
    df = c.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = c.join(df, "term").crossJoin(F.broadcast(n)).select("cluster", "term", ((1 + F.log("n")) * (F.log((1 + F.col("c")) / (1 + F.col("df"))) + 1)).alias("weight"))  # one row
    return top_per_group(w, ["cluster"], [F.desc(F.round("weight", 10)), F.asc("term")], 10).select("cluster", "term", "place")


def topic_pairs(spark, folder):
    """Overlaps of clusters' topics with the share of citations between them, that of all citations where there are none."""
    f = T.cross_flows(spark, folder)
    total = f.agg(F.sum("n").alias("t"), _n("k"))
    s = f.crossJoin(F.broadcast(total)).select("a", "b", (F.col("n") / F.col("t")).alias("share"))  # one row
    every = total.select((1 / F.col("k")).alias("mean"))
    x = T.topic_rbo(spark, folder).join(s, ["a", "b"], "left").crossJoin(F.broadcast(every))  # one row
    return x.select("a", "b", "rbo", F.round(F.coalesce("share", "mean"), 8).alias("share"))


def extreme_pairs(spark, folder):
    """The three pairs of clusters of most and of least overlap."""
    r = T.topic_rbo(spark, folder)
    ends = lambda name, *by: r.orderBy(*by, "a", "b").limit(3).select(F.lit(name).alias("end"), "a", "b", "rbo")
    return ends("most", F.desc("rbo")).union(ends("least", F.asc("rbo")))


def capitalised_concepts(spark, folder):
    """Concepts' names with capitals, by an alias where one is known, without those on a stop list."""
    n = X.one_blank("c.display_name")
    x = table(spark, folder, "papers").select(F.explode("concepts").alias("c")).select(F.lower(n).alias("n")).where("n <> ''")
    x = x.where(~F.col("n").isin(*STOPPED)).select(F.coalesce(F.element_at(F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv)), F.col("n")), F.col("n")).alias("n"))
    words = F.split("n", " ")
    name = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")
    return x.where(F.size(words) <= 6).select(name.alias("name")).groupBy("name").agg(_n())


STOPPED = ["indexing inventory", "closed-loop carbon corpus"]
ALIASES = {"remanufacturing waste": "waste", "malting emulsion": "emulsion"}


def trend_lags(spark, folder):
    """Each cluster's yearly works: how a year goes with the ones before it, at three distances."""
    y = works(spark, folder).where("cluster is not null and year is not null").groupBy("cluster", "year").agg(_n("y"))
    order = Window.partitionBy("cluster").orderBy("year")
    d = y.select("cluster", (F.col("y") - F.avg("y").over(Window.partitionBy("cluster"))).alias("d"), "year")
    x = d.select("cluster", "d", *(F.lag("d", k).over(order).alias(f"l{k}") for k in (1, 2, 3)))
    s = x.groupBy("cluster").agg(*(F.round(F.try_divide(F.sum(F.col("d") * F.col(f"l{k}")), F.sum(F.col("d") * F.col("d"))), 8).alias(f"lag_{k}") for k in (1, 2, 3)))
    return s


def judge_means(spark, folder):
    """Candidates' mean scores by judge, a column each, and how far the means are apart."""
    j = table(spark, folder, "judgements").where("parse_ok and bridge_validity between 1 and 5").select("candidate_id", F.lower(F.trim("judge")).alias("judge"), "bridge_validity")
    m = j.where("judge <> ''").groupBy("candidate_id", "judge").agg(F.avg("bridge_validity").alias("m"))
    sd = m.groupBy("candidate_id").agg(F.round(F.stddev_pop("m"), 8).alias("sd"), _n("n_judges"))
    wide = m.groupBy("candidate_id").agg(*(F.round(F.max(F.when(F.col("judge") == f"{k}-judge", F.col("m"))), 8).alias(k) for k in JUDGES))
    return wide.join(sd, "candidate_id")


JUDGES = ["atlas", "borea", "cinder"]


def ratio_variants(spark, folder):
    """Practice for talk in each source's documents, with the three ways to divide by little or nothing."""
    c = lambda ws: F.size(F.filter("w", lambda x: x.isin(ws)))
    d = table(spark, folder, "documents").where("text is not null").select(F.lower(blank_to_null("source")).alias("source"), X.words("text", 3).alias("w")).select("source", c(TALK).alias("t"), c(PRACTICE).alias("p"))
    g = d.groupBy("source").agg(F.avg("t").alias("t"), F.avg("p").alias("p"))
    return g.select("source", F.round(F.try_divide(F.col("p"), F.col("t")), 8).alias("plain"), F.round(F.col("p") / F.greatest("t", F.lit(0.01)), 8).alias("floored"), F.round(F.col("p") / F.greatest("t", F.lit(1.0)), 8).alias("counted"))


def titles_once(spark, folder):
    """One work per title, the most cited, works without a title apart."""
    w = works(spark, folder).select("work", F.lower(X.one_blank("title")).alias("t"), F.coalesce("citations", F.lit(0)).alias("c")).where("t <> ''")
    return w.groupBy("t").agg(_n(), F.min(F.struct(-F.col("c"), F.col("work")))["work"].alias("work")).select("work", "n")


def rotated_null(spark, folder):
    """The share of citations across clusters, against that with the clusters' labels moved on along the works."""
    w = works(spark, folder).where("cluster is not null").select("work", "cluster")
    return S.rotated_cross_share(citations(works(spark, folder)), w, "work", "cluster", ROTATIONS).select("n_draws", *(F.round(c, 8).alias(c) for c in ("observed", "mean", "sd", "z", "p_low", "p_high")))


ROTATIONS = 19


def modularity_z(spark, folder):
    """The clusters' modularity against that on graphs of the same degrees: z, corrected p and the middle 95 per cent."""
    w = works(spark, folder)
    e = G.labelled(citations(w), w, "work", "cluster")
    q = G.modularity(e).select(F.col("q").alias("observed"))
    pairs = G.undirected(e)
    draws = S.null_modularity(pairs, w.where("cluster is not null").select(F.col("work").alias("id"), F.col("cluster").alias("label")))
    n = draws.agg(_n("n_draws"), F.avg("q").alias("mean"), F.stddev_samp("q").alias("sd"), F.percentile("q", 0.025).alias("low"), F.percentile("q", 0.975).alias("high"), F.collect_list("q").alias("all"))  # a number a draw
    at_least = F.size(F.filter("all", lambda x: x >= F.col("observed")))
    return n.crossJoin(q).select("n_draws", "observed", "mean", "sd", "low", "high", F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")).alias("z"), ((1 + at_least) / (1 + F.col("n_draws"))).alias("p"))  # one row each


def k_selection(spark, folder):
    """Numbers of groups tried on the vectors: scatter measures of each, and the one chosen."""
    return V.k_selection(table(spark, folder, "embeddings"), "vec_id", "embedding", [4, 8, 12])


QUERIES = {f.__name__: f for f in (
    csv_round_trip, json_round_trip, log_round_trip, parts_round_trip, folder_round_trip, matrix_round_trip, index_export, json_export, coerced_lists, listed_names, filled_sources, fallback_texts,
    rebuilt_titles, reconciled_proposals, edges_without_flagged, close_vectors, davies_bouldin, large_centroids, sublinear_topics, topic_pairs, extreme_pairs, capitalised_concepts, trend_lags,
    judge_means, ratio_variants, titles_once, rotated_null, modularity_z, k_selection)}

_W = "WITH " + WORKS_SQL
_C = _W + ", " + CITATIONS_SQL
_L = _C + ", lab AS (SELECT src, dst, s.cluster AS sl, d.cluster AS dl FROM cites JOIN works s ON s.work = src JOIN works d ON d.work = dst WHERE s.cluster IS NOT NULL AND d.cluster IS NOT NULL)"
_b = lambda c: rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_in = lambda ws: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in ws)})))"
_CEN = """WITH el AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM el GROUP BY ALL)"""
_dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"

SQL = {
    "csv_round_trip": _W + " SELECT work, year, citations, doi FROM works WHERE year IS NOT NULL",
    "json_round_trip": _W + " SELECT concept, count(*) AS n FROM (SELECT unnest(concepts) AS concept FROM works) GROUP BY 1",
    "log_round_trip": "SELECT candidate_id, category FROM bridge_candidates",
    "parts_round_trip": _W + " SELECT type, count(*) AS n FROM works GROUP BY 1",
    "folder_round_trip": _W + " SELECT 'cluster=' || cluster AS part, count(*) AS n FROM works WHERE cluster IS NOT NULL GROUP BY 1",
    "matrix_round_trip": _L + " SELECT sl::VARCHAR AS a, dl::VARCHAR AS b, count(*)::DOUBLE AS value FROM lab WHERE sl::VARCHAR < dl::VARCHAR GROUP BY ALL",
    "index_export": _W + """ SELECT work, array_to_string(authors, '; ') AS authors, coalesce(year::VARCHAR, '') AS year, coalesce(citations::VARCHAR, '0') AS cited, CASE WHEN is_oa THEN 'All Open Access' ELSE '' END AS access, md5(array_to_string(refs, '; ')) AS refs FROM works""",
    "json_export": _W + """ SELECT '{"work":"' || work || '","year":' || coalesce(year::VARCHAR, 'null') || ',"citations":' || coalesce(citations::VARCHAR, 'null') || '}' AS json FROM works""",
    "coerced_lists": f"SELECT record_id, coalesce(len(list_filter(list_transform(string_split(replace(max(author_names), ';', '|'), '|'), lambda x: {_b('x')}), lambda x: x <> '')), 0)::INT AS n_items FROM scopus_records GROUP BY 1",
    "listed_names": f"SELECT record_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(a, '[;|]'), lambda x: lower({_b('x')})), lambda x: x <> '')))::INT AS n_items FROM (SELECT record_id, max(author_names) AS a FROM scopus_records GROUP BY 1) WHERE a IS NOT NULL",
    "filled_sources": _W + """, a AS (SELECT work FROM works WHERE doi IS NOT NULL ORDER BY work LIMIT 50), b AS (SELECT work FROM works WHERE abstract IS NOT NULL AND work NOT IN (SELECT work FROM a) ORDER BY work LIMIT 50) SELECT work FROM a UNION ALL SELECT work FROM b""",
    "fallback_texts": _W + """, d AS (SELECT upper(trim(paper_id)) AS work, min(text) AS v FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT work, md5(coalesce(v, abstract, title)) AS digest, CASE WHEN v IS NOT NULL THEN 'document' WHEN abstract IS NOT NULL THEN 'abstract' WHEN title IS NOT NULL THEN 'title' END AS origin FROM works LEFT JOIN d USING (work)""",
    "rebuilt_titles": _W + f" SELECT work, {_b('title')} AS title FROM works WHERE {_b('title')} <> ''",
    "reconciled_proposals": K._PROP + """, last AS (SELECT term_a AS root, term_b AS merged, arg_max(coalesce(category, ' none '), (candidate_id, coalesce(category, ' none '))) AS d FROM bridge_candidates WHERE sbert_cosine >= 0.6 GROUP BY 1, 2)
        SELECT prop.root, prop.merged, coalesce(upper(trim(d)), 'UNKNOWN') AS decision FROM prop LEFT JOIN last ON last.root = prop.root AND last.merged = prop.merged WHERE action = 'review'""",
    "edges_without_flagged": _C + """, k AS (SELECT work FROM works WHERE title IS NOT NULL AND year IS NOT NULL)
        SELECT 'works' AS what, count(*) AS n FROM k UNION ALL SELECT 'citations', count(*) FROM cites WHERE src IN (SELECT work FROM k) AND dst IN (SELECT work FROM k)""",
    "close_vectors": f"""WITH v AS (SELECT vec_id, embedding AS e, sqrt({_dot('embedding', 'embedding')}) AS l FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, {_dot('x.e', 'y.e')} / (x.l * y.l) AS c FROM v x JOIN v y ON x.vec_id < y.vec_id)
        SELECT a, b, round(c, 6) AS cosine FROM p WHERE c >= 0.3""",
    "davies_bouldin": _CEN + """, s AS (SELECT label, avg(d) AS s FROM (SELECT el.label, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM el JOIN m USING (label, i) GROUP BY ALL) GROUP BY 1),
        d AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)
        SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a, max((x.s + y.s) / d) AS r FROM d JOIN s x ON x.label = a JOIN s y ON y.label = b GROUP BY a)""",
    "large_centroids": _CEN + " SELECT label, max(n) AS n, round(sqrt(sum(m * m)), 6) AS length FROM m GROUP BY 1 HAVING max(n) >= 10",
    "sublinear_topics": T._N + """, x AS (SELECT cluster, term, (1 + ln(n)) * (ln((1 + (SELECT count(DISTINCT cluster) FROM cnt)) / (1 + count(*) OVER (PARTITION BY term))) + 1) AS weight FROM cnt)
        SELECT cluster, term, place FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY round(weight, 10) DESC, term) AS place FROM x) WHERE place <= 10""",
    "topic_pairs": f"""WITH r AS ({T.SQL['topic_rbo']}), f AS ({T.SQL['cross_flows']}) SELECT r.a, r.b, rbo, round(coalesce(n / (SELECT sum(n) FROM f), 1 / (SELECT count(*) FROM f)), 8) AS share FROM r LEFT JOIN f ON f.a = r.a AND f.b = r.b""",
    "extreme_pairs": f"""WITH r AS ({T.SQL['topic_rbo']}) SELECT * FROM (SELECT 'most' AS "end", a, b, rbo FROM r ORDER BY rbo DESC, a, b LIMIT 3) UNION ALL SELECT * FROM (SELECT 'least', a, b, rbo FROM r ORDER BY rbo, a, b LIMIT 3)""",
    "capitalised_concepts": f"""WITH x AS (SELECT lower({_b('c.display_name')}) AS n FROM (SELECT unnest(concepts) AS c FROM papers)), y AS (SELECT CASE {' '.join(f"WHEN n = '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE n END AS n FROM x WHERE n <> '' AND n NOT IN ({', '.join(repr(s) for s in STOPPED)}))
        SELECT array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, count(*) AS n FROM y WHERE len(string_split(y.n, ' ')) <= 6 GROUP BY 1""",
    "trend_lags": _W + """, y AS (SELECT cluster, year, count(*) AS y FROM works WHERE cluster IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2), d AS (SELECT cluster, year, y - avg(y) OVER (PARTITION BY cluster) AS d FROM y),
        x AS (SELECT cluster, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2, lag(d, 3) OVER w AS l3 FROM d WINDOW w AS (PARTITION BY cluster ORDER BY year))
        SELECT cluster, round(sum(d * l1) / nullif(sum(d * d), 0), 8) AS lag_1, round(sum(d * l2) / nullif(sum(d * d), 0), 8) AS lag_2, round(sum(d * l3) / nullif(sum(d * d), 0), 8) AS lag_3 FROM x GROUP BY 1""",
    "judge_means": f"""WITH m AS (SELECT candidate_id, lower(trim(judge)) AS judge, avg(bridge_validity) AS m FROM judgements WHERE parse_ok AND bridge_validity BETWEEN 1 AND 5 AND trim(judge) <> '' GROUP BY 1, 2)
        SELECT candidate_id, {', '.join(f"round(max(m) FILTER (judge = '{k}-judge'), 8) AS {k}" for k in JUDGES)}, round(stddev_pop(m), 8) AS sd, count(*) AS n_judges FROM m GROUP BY 1""",
    "ratio_variants": f"""WITH d AS (SELECT nullif(lower(trim(source)), '') AS source, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT source, avg({_in(TALK)}) AS t, avg({_in(PRACTICE)}) AS p FROM d GROUP BY 1)
        SELECT source, round(p / nullif(t, 0), 8) AS plain, round(p / greatest(t, 0.01), 8) AS floored, round(p / greatest(t, 1.0), 8) AS counted FROM g""",
    "titles_once": _W + f""", t AS (SELECT work, lower({_b('title')}) AS t, coalesce(citations, 0) AS c FROM works WHERE {_b('title')} <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY c DESC, work) AS rn, count(*) OVER (PARTITION BY t) AS n FROM t) SELECT work, n FROM r WHERE rn = 1""",
    "rotated_null": _C + f""", o AS MATERIALIZED (SELECT work, cluster, row_number() OVER (ORDER BY work) - 1 AS i, count(*) OVER () AS n FROM works WHERE cluster IS NOT NULL), r AS (SELECT unnest(range({ROTATIONS} + 1)) AS draw),
        ends AS MATERIALIZED (SELECT a.i AS ia, b.i AS ib, a.n FROM cites JOIN o a ON a.work = src JOIN o b ON b.work = dst),
        moved AS MATERIALIZED (SELECT draw, (ia + draw * (n // {ROTATIONS + 1})) % n AS ja, (ib + draw * (n // {ROTATIONS + 1})) % n AS jb FROM ends, r),
        s AS (SELECT draw, avg((x.cluster <> y.cluster)::INT) AS s FROM moved JOIN o x ON x.i = ja JOIN o y ON y.i = jb GROUP BY 1),
        z AS (SELECT count(*) AS n_draws, avg(s) AS mean, stddev_samp(s) AS sd FROM s WHERE draw > 0), b AS (SELECT s AS observed FROM s WHERE draw = 0)
        SELECT n_draws, round(observed, 8) AS observed, round(mean, 8) AS mean, round(sd, 8) AS sd, round((observed - mean) / nullif(sd, 0), 8) AS z,
            round((1 + (SELECT count(*) FROM s WHERE draw > 0 AND s <= observed)) / (n_draws + 1), 8) AS p_low, round((1 + (SELECT count(*) FROM s WHERE draw > 0 AND s >= observed)) / (n_draws + 1), 8) AS p_high FROM z, b""",
}
