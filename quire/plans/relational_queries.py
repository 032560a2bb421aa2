"""Queries over relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ids import blank_to_null, doi_key
from quire.operators import relational as R
from quire.sources.tables import table
from quire.sources.works import WORKS_SQL, works

#: Regions that count as the north, a parameter of the geographic queries.
NORTH = ("EUROPE", "AMERICA")
TERMS = {"compost": "compost", "fibre": "fibre", "glass": "glass"}


def _located(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (order, area, nation, region) through line item and supplier; the small sides are
    left to the planner, which knows their sizes."""
    t = lambda n: table(spark, folder, n)
    return (
        t("lineitem").select("l_orderkey", "l_suppkey").distinct()
        .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("area")), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "area", "n_name", "r_name").distinct()
    )


def geo_top_countries(spark, folder):
    n = _located(spark, folder).groupBy("area", "n_name").agg(F.count(F.lit(1)).alias("n_papers"))
    n = R.share_of_group(n, "n_papers", ["area"])
    return R.top_per_group(n, ["area"], [F.desc("n_papers"), F.asc("n_name")], 5).withColumn("share", F.round("share", 8))


def geo_region_split(spark, folder):
    side = F.when(F.col("r_name").isin(*NORTH), "north").when(F.col("r_name").isNotNull(), "south").otherwise("unknown")
    return (
        _located(spark, folder).select("l_orderkey", "area", side.alias("side")).distinct()
        .groupBy("area").pivot("side", ["north", "south", "unknown"]).agg(F.count(F.lit(1))).na.fill(0)
    )


def geo_coverage(spark, folder):
    located = _located(spark, folder).groupBy("area").agg(F.countDistinct("l_orderkey").alias("n_located"))
    every = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(F.countDistinct("o_orderkey").alias("n_papers"))
    return every.join(located, "area", "left").select("area", "n_papers", F.coalesce("n_located", F.lit(0)).alias("n_located"), F.round(F.coalesce("n_located", F.lit(0)) / F.col("n_papers"), 8).alias("coverage"))


def paper_level_category(spark, folder):
    flags = _located(spark, folder).groupBy("area", "l_orderkey").agg(F.max(F.col("r_name").isin(*NORTH)).alias("north"), F.max(~F.col("r_name").isin(*NORTH)).alias("south"))
    kind = F.when(F.col("north") & F.col("south"), "collaboration").when(F.col("north"), "north only").otherwise("south only")
    return flags.groupBy("area", kind.alias("category")).agg(F.count(F.lit(1)).alias("n_papers"))


def country_concentration(spark, folder):
    n = _located(spark, folder).groupBy("area", "n_name").agg(F.count(F.lit(1)).alias("n_papers"))
    return R.concentration(n, "area", "n_name", "n_papers").select("area", "n_name", "n_papers", F.round("share", 8).alias("share"), F.round("index", 8).alias("index"))


def solo_vs_collab(spark, folder):
    x = _located(spark, folder)
    size = x.groupBy("l_orderkey").agg(F.countDistinct("n_name").alias("m"))
    return x.select("l_orderkey", "n_name").distinct().join(size, "l_orderkey").groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_papers"), F.count_if(F.col("m") == 1).alias("n_solo"), F.count_if(F.col("m") > 1).alias("n_international")
    )


def area_summary(spark, folder):
    w = works(spark, folder)
    return w.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.floor(F.percentile("citations", 0.5)).cast("bigint").alias("median_citations"),
        F.array_join(F.array_sort(F.collect_set("type")), "; ").alias("types"),
    )


def decade_pivot(spark, folder):
    cols = [1980, 1990, 2000, 2010, 2020]
    w = works(spark, folder).where("year is not null").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))
    return w.groupBy("cluster").pivot("decade", cols).agg(F.count(F.lit(1))).na.fill(0).select("cluster", *(F.col(str(c)).alias(f"d{c}") for c in cols))


def top_cited_per_area(spark, folder):
    w = works(spark, folder).where("citations is not null")
    return R.top_per_group(w.select("cluster", "work", "citations"), ["cluster"], [F.desc("citations"), F.asc("work")], 10)


def spread_by_area(spark, folder):
    v = F.col("citations").cast("double")
    return works(spark, folder).groupBy("cluster").agg(
        F.count("citations").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd_sample"), F.round(F.stddev_pop(v), 6).alias("sd_population"),
        *(F.round(F.percentile(v, p), 6).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75, 0.9, 0.95)),
    )


def two_phase_join(spark, folder):
    left = table(spark, folder, "scopus_records").select("record_id", "doi").distinct().where("doi is not null")
    right = table(spark, folder, "papers").select("doi", "openalex_id").where("doi is not null").groupBy("doi").agg(F.min("openalex_id").alias("first_id"))
    return R.two_phase_join(left, right, "doi", doi_key("doi"), ["first_id"]).groupBy("record_id", "phase").agg(F.min("first_id").alias("first_id"))


def incomplete_records(spark, folder):
    w = works(spark, folder)
    bad = {"no_abstract": F.coalesce(F.trim("abstract"), F.lit("")) == "", "no_concept": F.size("concepts") == 0, "no_year": F.col("year").isNull()}
    return w.where(bad["no_abstract"] | bad["no_concept"] | bad["no_year"]).select("work", *(c.alias(n) for n, c in bad.items()))


def completeness(spark, folder):
    w = works(spark, folder)
    have = lambda c: F.count_if(c)
    return w.agg(
        F.count(F.lit(1)).alias("n"), have(F.coalesce(F.trim("abstract"), F.lit("")) != "").alias("with_abstract"), have(F.col("doi").isNotNull()).alias("with_doi"),
        have(F.col("year").isNotNull()).alias("with_year"), have(F.size("authors") > 0).alias("with_authors"), have(F.size("refs") > 0).alias("with_refs"),
    )


def membership_flags(spark, folder):
    w = works(spark, folder).select("work", "doi")
    s = table(spark, folder, "scopus_records").select(doi_key("doi").alias("doi")).where("doi is not null").distinct()
    a = w.join(s, "doi", "left_semi").select("work", F.lit("both").alias("where_"))
    return a.union(w.join(s, "doi", "left_anti").select("work", F.lit("papers only").alias("where_")))


def dedupe_corpus(spark, folder):
    p = table(spark, folder, "papers").select("openalex_id", "doi", "title", "publication_year", "ingested_at")
    title = F.lower(F.regexp_replace(F.trim("title"), r"\s+", " "))
    return R.dedupe_by_keys(p, doi_key("doi"), [title, F.col("publication_year")], ["ingested_at", "openalex_id"]).select("openalex_id", "ingested_at")


def best_duplicate(spark, folder):
    x = table(spark, folder, "bridge_candidates").select("term_a", "term_b", "sbert_cosine", "candidate_id")
    key = x.select(F.least("term_a", "term_b").alias("a"), F.greatest("term_a", "term_b").alias("b"), "sbert_cosine", "candidate_id")
    return R.top_per_group(key, ["a", "b"], [F.desc("sbert_cosine"), F.asc("candidate_id")], 1).drop("place")


def term_intersections(spark, folder):
    return R.intersections(table(spark, folder, "documents"), "text", TERMS)


def phrase_filter(spark, folder):
    d = table(spark, folder, "documents")
    words = F.size(F.filter(F.split(F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+$", ""), r"[ \t\n\r]+"), lambda x: x != ""))
    return d.where(R.any_term(["text"], ["no difference", "energy demand"]) & ~F.lower("text").contains("keywords") & (words >= 20)).select("doc_id", words.alias("n_words"))


PERIODS = [("early", 1500, 1899), ("modern", 1900, 1979), ("eighties", 1980, 1989), ("nineties", 1990, 1999), ("noughties", 2000, 2009), ("tens", 2010, 2019), ("recent", 2020, 2100)]


def period_buckets(spark, folder):
    y = F.col("year")
    name = F.coalesce(*(F.when(y.between(a, b), n) for n, a, b in PERIODS))
    return works(spark, folder).groupBy(name.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("citations").alias("citations"))


def quantile_bins(spark, folder):
    w = works(spark, folder).select("work", F.coalesce("year", F.lit(2020)).alias("year"))
    return R.bins_by_quantile(w, "year", 5).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("low"), F.max("year").alias("high"))


def collected_lists(spark, folder):
    w = works(spark, folder).select("work", "concepts")
    names = table(spark, folder, "papers").select(F.explode("concepts").alias("c")).groupBy("c.concept_id").agg(F.min("c.display_name").alias("name"))
    hit = w.select("work", F.explode("concepts").alias("concept_id")).join(names, "concept_id").groupBy("work").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))
    return w.select("work").join(hit, "work", "left")


def value_shares(spark, folder):
    s = F.coalesce(F.lower(blank_to_null("source")), F.lit("(missing)"))
    n = table(spark, folder, "documents").groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(R.Window.partitionBy()), 8))


def mode_by_area(spark, folder):
    return R.mode_first(works(spark, folder), ["cluster"], "year").withColumnRenamed("mode", "year")


def similarity_histogram(spark, folder):
    b = F.floor(F.least(F.lit(0.999999), F.greatest(F.lit(0.0), F.col("sbert_cosine"))) * 20)
    return table(spark, folder, "bridge_candidates").where("sbert_cosine is not null").groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def contingency(spark, folder):
    w = works(spark, folder).where("is_oa is not null")
    return w.groupBy("type").pivot("is_oa", [True, False]).agg(F.count(F.lit(1))).na.fill(0).select("type", F.col("true").alias("open"), F.col("false").alias("closed"))


def page_by_citations(spark, folder):
    return works(spark, folder).select("work", F.coalesce("citations", F.lit(0)).alias("citations")).orderBy(F.desc("citations"), "work").offset(20).limit(10)


def diverse_examples(spark, folder):
    d = table(spark, folder, "documents").select(F.lower(blank_to_null("lang")).alias("lang"), F.lower(blank_to_null("source")).alias("source"), "doc_id").where("lang is not null and source is not null")
    return R.diverse_examples(d, "lang", "source", ["doc_id"], 12)


def decision_precedence(spark, folder):
    """Each candidate's decision: that of the judge of highest precedence; judges outside the list come
    after it, by their value and then their name."""
    j = table(spark, folder, "judgements").where("parse_ok").groupBy("candidate_id", F.lower(blank_to_null("judge")).alias("source")).agg(F.max("bridge_validity").alias("value"))
    j = j.where("source is not null").withColumn("order", F.struct("value", "source"))
    return R.decide(j, "candidate_id", {"atlas-judge": 3, "borea-judge": 2, "cinder-judge": 1}).select("candidate_id", "source", "value")


def judge_summary(spark, folder):
    j = table(spark, folder, "judgements").where("parse_ok and bridge_validity between 1 and 5").select("candidate_id", F.lower(blank_to_null("judge")).alias("judge"), "bridge_validity").distinct()
    per = j.groupBy("candidate_id", "judge").agg(F.avg("bridge_validity").alias("m"))
    out = per.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n_judges"), F.round(F.avg("m"), 8).alias("mean"), F.round(F.stddev_pop("m"), 8).alias("sd_of_means"))
    grade = F.when(F.col("sd_of_means") < 0.5, "high").when(F.col("sd_of_means") < 1.0, "medium").otherwise("low")
    return out.withColumn("agreement", grade)


def consensus_votes(spark, folder):
    j = table(spark, folder, "judgements").where("parse_ok").groupBy("candidate_id", F.lower(blank_to_null("judge")).alias("judge")).agg(
        F.min(F.least("semantic_equivalence", "bridge_validity", "ontological_groundedness")).alias("least_"), F.count(F.lit(1)).alias("k"))
    yes = F.sum(F.when(F.col("least_") >= 3, 1).otherwise(0))
    return j.groupBy("candidate_id").agg(yes.alias("votes")).withColumn("is_bridge", F.col("votes") >= 2)


def fill_from_sources(spark, folder):
    w = works(spark, folder).select("work", "abstract")
    d = table(spark, folder, "documents").where("paper_id is not null and text is not null").groupBy(F.upper(F.trim("paper_id")).alias("work")).agg(F.min(F.struct("doc_id", "text")).alias("d"))
    empty = F.coalesce(F.trim("abstract"), F.lit("")).isin("", "n/a")
    x = w.join(d, "work", "left")
    return x.select("work", F.when(~empty, "delivered").when(F.col("d.text").isNotNull(), "document").otherwise("none").alias("origin"), F.length(F.when(~empty, F.col("abstract")).otherwise(F.col("d.text"))).alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    geo_top_countries, geo_region_split, geo_coverage, paper_level_category, country_concentration, solo_vs_collab, area_summary, decade_pivot,
    top_cited_per_area, spread_by_area, two_phase_join, incomplete_records, completeness, membership_flags, dedupe_corpus, best_duplicate,
    term_intersections, phrase_filter, period_buckets, quantile_bins, collected_lists, value_shares, mode_by_area, similarity_histogram, contingency,
    page_by_citations, diverse_examples, decision_precedence, judge_summary, consensus_votes, fill_from_sources)}

_LOC = """WITH loc AS (SELECT DISTINCT l_orderkey, o_orderpriority AS area, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey)
"""
_W = "WITH " + WORKS_SQL
_DOI = r"nullif(lower(regexp_extract(doi, '(10\.\d{4,9}/\S+)', 1)), '')"
_CASES = " ".join(f"WHEN year BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in PERIODS)
_flag = lambda t: f"(coalesce(contains(lower(text), '{t}'), false))::INT"
_COMBOS = [("compost",), ("fibre",), ("glass",), ("compost", "fibre"), ("compost", "glass"), ("fibre", "glass"), ("compost", "fibre", "glass")]
_JUDGE = "nullif(lower(trim(judge)), '')"

SQL = {
    "geo_top_countries": _LOC + """SELECT area, n_name, n_papers, round(n_papers / total, 8) AS share, place FROM (
        SELECT *, sum(n_papers) OVER (PARTITION BY area) AS total, row_number() OVER (PARTITION BY area ORDER BY n_papers DESC, n_name) AS place
        FROM (SELECT area, n_name, count(*) AS n_papers FROM loc GROUP BY ALL)) WHERE place <= 5""",
    "geo_region_split": _LOC + """SELECT area, count(*) FILTER (side = 'north') AS north, count(*) FILTER (side = 'south') AS south, count(*) FILTER (side = 'unknown') AS unknown
        FROM (SELECT DISTINCT l_orderkey, area, CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'north' WHEN r_name IS NOT NULL THEN 'south' ELSE 'unknown' END AS side FROM loc) GROUP BY area""",
    "geo_coverage": _LOC + """SELECT o_orderpriority AS area, count(DISTINCT o_orderkey) AS n_papers, count(DISTINCT l_orderkey) AS n_located,
        round(count(DISTINCT l_orderkey) / count(DISTINCT o_orderkey), 8) AS coverage FROM orders LEFT JOIN loc ON l_orderkey = o_orderkey GROUP BY ALL""",
    "paper_level_category": _LOC + """SELECT area, CASE WHEN n AND s THEN 'collaboration' WHEN n THEN 'north only' ELSE 'south only' END AS category, count(*) AS n_papers
        FROM (SELECT area, l_orderkey, bool_or(r_name IN ('EUROPE', 'AMERICA')) AS n, bool_or(r_name NOT IN ('EUROPE', 'AMERICA')) AS s FROM loc GROUP BY ALL) GROUP BY ALL""",
    "country_concentration": _LOC + """, c AS (SELECT area, n_name, count(*) AS n_papers FROM loc GROUP BY ALL)
        SELECT area, n_name, n_papers, round(n_papers / sum(n_papers) OVER (PARTITION BY area), 8) AS share,
        round((n_papers / sum(n_papers) OVER (PARTITION BY area)) / (sum(n_papers) OVER (PARTITION BY n_name) / sum(n_papers) OVER ()), 8) AS "index" FROM c""",
    "solo_vs_collab": _LOC + """, u AS (SELECT DISTINCT l_orderkey, n_name FROM loc), s AS (SELECT l_orderkey, count(*) AS m FROM u GROUP BY 1)
        SELECT n_name, count(*) AS n_papers, count(*) FILTER (m = 1) AS n_solo, count(*) FILTER (m > 1) AS n_international FROM u JOIN s USING (l_orderkey) GROUP BY 1""",
    "area_summary": _W + """SELECT cluster, count(*) AS n, min(year) AS first_year, max(year) AS last_year, floor(quantile_cont(citations, 0.5))::BIGINT AS median_citations,
        string_agg(DISTINCT type, '; ' ORDER BY type) AS types FROM works GROUP BY cluster""",
    "decade_pivot": _W + "SELECT cluster, " + ", ".join(f"count(*) FILTER (year // 10 * 10 = {c}) AS d{c}" for c in (1980, 1990, 2000, 2010, 2020)) + " FROM works WHERE year IS NOT NULL GROUP BY cluster",
    "top_cited_per_area": _W + """SELECT cluster, work, citations, place FROM (SELECT cluster, work, citations, row_number() OVER (PARTITION BY cluster ORDER BY citations DESC, work) AS place
        FROM works WHERE citations IS NOT NULL) WHERE place <= 10""",
    "spread_by_area": _W + "SELECT cluster, count(citations) AS n, round(avg(citations), 6) AS mean, round(stddev_samp(citations), 6) AS sd_sample, round(stddev_pop(citations), 6) AS sd_population, "
        + ", ".join(f"round(quantile_cont(citations, {p}), 6) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95)) + " FROM works GROUP BY cluster",
    "two_phase_join": f"""WITH l AS (SELECT DISTINCT record_id, doi, {_DOI} AS k FROM scopus_records WHERE doi IS NOT NULL),
        r AS (SELECT doi, {_DOI} AS k, min(openalex_id) AS first_id FROM papers WHERE doi IS NOT NULL GROUP BY 1, 2),
        one AS (SELECT record_id, 'exact' AS phase, first_id FROM l JOIN r ON l.doi = r.doi),
        two AS (SELECT record_id, 'loose' AS phase, first_id FROM l JOIN r ON l.k = r.k WHERE l.doi NOT IN (SELECT doi FROM r))
        SELECT record_id, phase, min(first_id) AS first_id FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL""",
    "incomplete_records": _W + """SELECT * FROM (SELECT work, coalesce(trim(abstract), '') = '' AS no_abstract, len(concepts) = 0 AS no_concept, year IS NULL AS no_year FROM works) WHERE no_abstract OR no_concept OR no_year""",
    "completeness": _W + """SELECT count(*) AS n, count(*) FILTER (coalesce(trim(abstract), '') <> '') AS with_abstract, count(doi) AS with_doi, count(year) AS with_year,
        count(*) FILTER (len(authors) > 0) AS with_authors, count(*) FILTER (len(refs) > 0) AS with_refs FROM works""",
    "membership_flags": _W + f", s AS (SELECT DISTINCT {_DOI} AS d FROM scopus_records) SELECT work, CASE WHEN doi IN (SELECT d FROM s WHERE d IS NOT NULL) THEN 'both' ELSE 'papers only' END AS where_ FROM works",
    "dedupe_corpus": f"""WITH p AS (SELECT openalex_id, ingested_at, {_DOI} AS k, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS t, publication_year AS y FROM papers),
        a AS (SELECT openalex_id, ingested_at, row_number() OVER (PARTITION BY k ORDER BY ingested_at, openalex_id) AS rn FROM p WHERE k IS NOT NULL),
        b AS (SELECT openalex_id, ingested_at, row_number() OVER (PARTITION BY t, y ORDER BY ingested_at, openalex_id) AS rn FROM p WHERE k IS NULL)
        SELECT openalex_id, ingested_at FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rn = 1""",
    "best_duplicate": """SELECT a, b, sbert_cosine, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY sbert_cosine DESC NULLS LAST, candidate_id) AS rn
        FROM (SELECT least(term_a, term_b) AS a, greatest(term_a, term_b) AS b, sbert_cosine, candidate_id FROM bridge_candidates)) WHERE rn = 1""",
    "term_intersections": " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS terms, coalesce(sum({' * '.join(_flag(t) for t in c)}), 0)::BIGINT AS n FROM documents" for c in _COMBOS),
    "phrase_filter": r"""SELECT doc_id, n_words FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''))::INT AS n_words FROM documents)
        WHERE (contains(lower(text), 'no difference') OR contains(lower(text), 'energy demand')) AND NOT contains(lower(text), 'keywords') AND n_words >= 20""",
    "period_buckets": _W + f"SELECT CASE {_CASES} END AS period, count(*) AS n, sum(citations)::BIGINT AS citations FROM works GROUP BY 1",
    "quantile_bins": _W + """, y AS (SELECT work, coalesce(year, 2020) AS year FROM works), e AS (SELECT list_distinct(quantile_cont(year, [0, 0.2, 0.4, 0.6, 0.8, 1])) AS e FROM y)
        SELECT bin, count(*) AS n, min(year) AS low, max(year) AS high FROM (SELECT year, greatest(1, len(list_filter(e, lambda x: x < year)))::INT AS bin FROM y, e) GROUP BY bin""",
    "collected_lists": _W + """, names AS (SELECT c.concept_id AS id, min(c.display_name) AS name FROM (SELECT unnest(concepts) AS c FROM papers) GROUP BY 1),
        hit AS (SELECT work, string_agg(DISTINCT name, '; ' ORDER BY name) AS names FROM (SELECT work, unnest(concepts) AS id FROM works) JOIN names USING (id) GROUP BY work)
        SELECT work, CASE WHEN h.work IS NOT NULL THEN coalesce(names, '') END AS names FROM works LEFT JOIN hit h USING (work)""",
    "value_shares": """SELECT source, n, round(100 * n / sum(n) OVER (), 8) AS percent FROM (SELECT coalesce(nullif(lower(trim(source)), ''), '(missing)') AS source, count(*) AS n FROM documents GROUP BY 1)""",
    "mode_by_area": _W + """SELECT cluster, year, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, year) AS rn FROM (SELECT cluster, year, count(*) AS n FROM works WHERE year IS NOT NULL GROUP BY ALL)) WHERE rn = 1""",
    "similarity_histogram": "SELECT floor(least(0.999999, greatest(0.0, sbert_cosine)) * 20)::INT AS bucket, count(*) AS n FROM bridge_candidates WHERE sbert_cosine IS NOT NULL GROUP BY 1",
    "contingency": _W + "SELECT type, count(*) FILTER (is_oa) AS open, count(*) FILTER (NOT is_oa) AS closed FROM works WHERE is_oa IS NOT NULL GROUP BY type",
    "page_by_citations": _W + "SELECT work, coalesce(citations, 0) AS citations FROM works ORDER BY 2 DESC, 1 LIMIT 10 OFFSET 20",
    "diverse_examples": """WITH d AS (SELECT nullif(lower(trim(lang)), '') AS lang, nullif(lower(trim(source)), '') AS source, doc_id FROM documents), u AS (SELECT * FROM d WHERE lang IS NOT NULL AND source IS NOT NULL),
        m AS (SELECT lang, greatest(2, 12 // count(DISTINCT source)) AS most FROM u GROUP BY lang),
        p AS (SELECT u.*, row_number() OVER (PARTITION BY u.lang, source ORDER BY doc_id) > most AS late FROM u JOIN m USING (lang))
        SELECT lang, source, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY late, doc_id) AS place FROM p) WHERE place <= 12""",
    "decision_precedence": f"""SELECT candidate_id, source, value FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY source) AS rn FROM (
        SELECT candidate_id, {_JUDGE} AS source, max(bridge_validity) AS value FROM judgements WHERE parse_ok GROUP BY 1, 2) WHERE source IN ('atlas-judge', 'borea-judge', 'cinder-judge')) WHERE rn = 1""",
    "judge_summary": f"""WITH j AS (SELECT DISTINCT candidate_id, {_JUDGE} AS judge, bridge_validity AS v FROM judgements WHERE parse_ok AND bridge_validity BETWEEN 1 AND 5),
        s AS (SELECT candidate_id, count(*) AS n_judges, round(avg(m), 8) AS mean, round(stddev_pop(m), 8) AS sd_of_means FROM (SELECT candidate_id, judge, avg(v) AS m FROM j GROUP BY ALL) GROUP BY 1)
        SELECT *, CASE WHEN sd_of_means < 0.5 THEN 'high' WHEN sd_of_means < 1.0 THEN 'medium' ELSE 'low' END AS agreement FROM s""",
    "consensus_votes": f"""SELECT candidate_id, votes, votes >= 2 AS is_bridge FROM (SELECT candidate_id, sum(CASE WHEN l >= 3 THEN 1 ELSE 0 END)::BIGINT AS votes FROM (
        SELECT candidate_id, {_JUDGE} AS judge, min(least(semantic_equivalence, bridge_validity, ontological_groundedness)) AS l FROM judgements WHERE parse_ok GROUP BY 1, 2) GROUP BY 1)""",
    "fill_from_sources": _W + """, d AS (SELECT upper(trim(paper_id)) AS work, arg_min(text, doc_id) AS text FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL GROUP BY 1)
        SELECT work, CASE WHEN NOT e THEN 'delivered' WHEN t IS NOT NULL THEN 'document' ELSE 'none' END AS origin, length(CASE WHEN NOT e THEN abstract ELSE t END)::INT AS n_chars
        FROM (SELECT w.work, abstract, d.text AS t, coalesce(trim(abstract), '') IN ('', 'n/a') AS e FROM works w LEFT JOIN d USING (work))""",
}
