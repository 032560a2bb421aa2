"""Queries over texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null, doi_key
from quire.operators.relational import top_per_group
from quire.sources.tables import table

STOP = ["the", "and", "that", "for", "with", "from", "was", "were", "are", "this", "than", "when", "once", "after", "before", "under", "our", "not"]
TALK, PRACTICE = ["suggest", "examine", "propose"], ["measured", "collected", "screened", "recovered"]


def _docs(spark, folder):
    return table(spark, folder, "documents")


def cleaned_texts(spark, folder):
    t = X.clean("text", [r"keywords\s*:", r"all rights reserved"])
    return _docs(spark, folder).select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


def protected_phrases(spark, folder):
    t = X.protect_phrases("text", ["energy demand", "per cent", "energy demand fell"])
    c = lambda s: F.regexp_count(t, F.lit(s))
    return _docs(spark, folder).select("doc_id", c("energy_demand_fell").alias("long"), c("energy_demand(?!_)").alias("short"), c("per_cent").alias("other")).where("long + short + other > 0")


def token_counts(spark, folder):
    w = _docs(spark, folder).select(F.explode(X.words("text", 3, STOP)).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


def unigrams_and_bigrams(spark, folder):
    t = _docs(spark, folder).select("doc_id", F.explode(X.terms("text", STOP)).alias("term"))
    n = t.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
    return n.where("n_docs >= 30")


def sentence_lengths(spark, folder):
    s = _docs(spark, folder).select("lang", F.explode(X.sentences("text")).alias("s"))
    return s.groupBy(F.lower(F.trim("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("n_chars"), F.max(F.length("s")).alias("longest"))


def doi_spellings(spark, folder):
    return table(spark, folder, "papers").where("doi is not null").select(doi_key("doi").alias("doi"), "openalex_id").groupBy("doi").agg(F.countDistinct("openalex_id").alias("n_ids"))


def slugs(spark, folder):
    return table(spark, folder, "ingredients").select("node_id", X.slug("label").alias("slug")).distinct()


def years_in_titles(spark, folder):
    return _docs(spark, folder).select("doc_id", X.first_year("text").alias("number")).where("number is not null")


def keyword_lists(spark, folder):
    k = F.regexp_extract("text", r"Keywords:([^\n]*)", 1)
    return _docs(spark, folder).where(F.col("text").contains("Keywords:")).select("doc_id", F.array_join(X.list_items(k, ";"), "; ").alias("keywords"))


def lexicon_ratio(spark, folder):
    talk, practice = X.count_terms("text", X.escape(TALK)), X.count_terms("text", X.escape(PRACTICE))
    return _docs(spark, folder).select("doc_id", talk.alias("talk"), practice.alias("practice"), F.round(F.try_divide(practice.cast("double"), F.nullif(talk, F.lit(0))), 8).alias("ratio"))


def lexicon_terms(spark, folder):
    found = F.regexp_extract_all(F.lower(X.one_blank("text")), F.lit(r"\b(" + "|".join(TALK + PRACTICE) + r")\b"), 1)
    return _docs(spark, folder).select("doc_id", F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def sector_hits(spark, folder):
    sectors = {"energy": "energy|battery|heat", "food": "food|recipe|cream", "textile": "textile|fibre"}
    d = _docs(spark, folder).select(F.coalesce(F.lower(blank_to_null("source")), F.lit("(none)")).alias("source"), *(F.coalesce(F.col("text").rlike(p), F.lit(False)).cast("int").alias(n) for n, p in sectors.items()))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.round(100 * F.avg(s), 8).alias(s) for s in sectors))


def context_words(spark, folder):
    """Words within ten places of a term, by how often."""
    w = _docs(spark, folder).select("doc_id", X.words("text", 1).alias("w"))
    at = w.select("w", F.posexplode("w").alias("i", "t")).where("t = 'compost'")
    near = at.select(F.explode(F.slice("w", F.greatest(F.lit(1), F.col("i") - 9), F.lit(10) + F.least(F.lit(10), F.col("i")) + 1)).alias("t"))
    n = near.where((F.length("t") >= 3) & ~F.col("t").isin(*STOP, "compost")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n >= 5")


def anagram_labels(spark, folder):
    l = table(spark, folder, "ingredients").where("label is not null").select(X.one_blank(X.fold_accents("label")).alias("label")).distinct()
    k = l.select("label", F.array_join(F.array_sort(F.split("label", " ")), " ").alias("k"))
    return k.alias("a").join(k.alias("b"), "k").where("a.label < b.label").select(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"))


def stems_and_singulars(spark, folder):
    l = table(spark, folder, "ingredients").select(F.explode(X.words("label", 3)).alias("w")).distinct()
    return l.select("w", X.stem("w").alias("stem"), X.singular("w").alias("singular"))


def ontology_grade(spark, folder):
    l = table(spark, folder, "ingredients").where("label is not null").select(F.lower(X.one_blank("label")).alias("label")).where("label <> ''").distinct()
    f = table(spark, folder, "foodon_terms").select("foodon_id", "foodon_label")
    tokens = l.select("label", F.explode(F.array_distinct(X.words(X.fold_accents("label"), 1))).alias("t"))
    names = f.select("foodon_id", "foodon_label", F.explode(F.array_distinct(X.words("foodon_label", 1))).alias("t"))
    pairs = tokens.join(names, "t").select("label", "foodon_id", "foodon_label").distinct()
    grade, confidence = X.match_grade(F.col("label"), F.col("foodon_label"))
    scored = pairs.select("label", "foodon_id", grade.alias("grade"), F.round(confidence, 8).alias("confidence"))
    return top_per_group(scored, ["label"], [F.desc("confidence"), F.asc("foodon_id")], 1).drop("place")


def ingredient_names(spark, folder):
    return table(spark, folder, "ingredients").where("label is not null").select("node_id", X.ingredient_name("label").alias("name")).distinct()


def plain_pages(spark, folder):
    """Every document without the markup of wikis and HTML, null texts as empty ones."""
    return _docs(spark, folder).select("doc_id", F.md5(X.without_markup(F.coalesce(F.col("text"), F.lit("")))).alias("digest"))


def placeholders(spark, folder):
    m = X.marker_found("abstract", ["not provided", "no abstract", "n/a"])
    return table(spark, folder, "papers").select(m.alias("marker")).where("marker is not null").groupBy("marker").agg(F.count(F.lit(1)).alias("n"))


def verbatim_titles(spark, folder):
    """Whether a document of a paper holds the paper's title as it stands."""
    d = _docs(spark, folder).where("paper_id is not null and text is not null").select("doc_id", F.upper(F.trim("paper_id")).alias("k"), F.lower(X.one_blank("text")).alias("t"))
    p = table(spark, folder, "papers").where("title is not null").select(F.upper(F.trim("openalex_id")).alias("k"), F.lower(X.one_blank("title")).alias("title")).distinct()
    return d.join(p, "k").select("doc_id", F.col("t").contains(F.col("title")).alias("verbatim")).groupBy("doc_id").agg(F.max("verbatim").alias("verbatim"))


def safe_cells(spark, folder):
    return _docs(spark, folder).where("text is not null").select("doc_id", X.safe_cell("text").alias("t")).select("doc_id", F.length("t").alias("n"), F.substring("t", 1, 1).alias("first"))


def json_props(spark, folder):
    k = X.lenient_json(F.concat(F.lit("answer: ```"), F.col("props"), F.lit("``` end")), "k bigint")["k"]
    return table(spark, folder, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_read"), F.sum("k").alias("sum_k"))


def concept_lists(spark, folder):
    names = F.transform("concepts", lambda c: F.initcap(X.one_blank(c["display_name"])))
    few = F.filter(names, lambda n: (F.size(F.split(n, " ")) <= 3) & (n != ""))
    return table(spark, folder, "papers").select("openalex_id", "ingested_at", F.array_join(F.array_distinct(few), "; ").alias("concepts"))


QUERIES = {f.__name__: f for f in (
    cleaned_texts, protected_phrases, token_counts, unigrams_and_bigrams, sentence_lengths, doi_spellings, slugs, years_in_titles, keyword_lists, lexicon_ratio,
    lexicon_terms, sector_hits, context_words, anagram_labels, stems_and_singulars, ontology_grade, ingredient_names, plain_pages, placeholders, verbatim_titles,
    safe_cells, json_props, concept_lists)}

_stop = ", ".join(f"'{s}'" for s in STOP)
_words = lambda c, least=3, stop=True: f"list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= {least}{f' AND w NOT IN ({_stop})' if stop else ''})"
_blank = lambda c: rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_fold = lambda c: f"translate(lower({c}), '{X.ACCENTED}', '{X.FOLDED}')"
_rep = lambda c, *ps: _rep(f"regexp_replace({c}, '{ps[0]}', ' ', 'g')", *ps[1:]) if ps else c
_lex = lambda ts: f"len(regexp_extract_all(lower({_blank('text')}), '\\b(" + "|".join(ts) + ")\\b'))"

SQL = {
    "cleaned_texts": "SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, " + _blank(_rep(_blank("text"), r"https?://\S+", r"(?i)\bdoi:?\s*10\.\d{4,9}/\S+", r"©\s*\d{4}", r"(?i)keywords\s*:", "(?i)all rights reserved")) + " AS t FROM documents)",
    "protected_phrases": """SELECT * FROM (SELECT doc_id, len(regexp_extract_all(t, 'energy demand fell'))::INT AS long, (len(regexp_extract_all(t, 'energy demand')) - len(regexp_extract_all(t, 'energy demand fell')))::INT AS short,
        len(regexp_extract_all(t, 'per cent'))::INT AS other FROM (SELECT doc_id, lower(text) AS t FROM documents)) WHERE long + short + other > 0""",
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({_words('text')}) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 20",
    "unigrams_and_bigrams": f"""WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents),
        t AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)
        SELECT term, count(*) AS n_docs FROM t GROUP BY 1 HAVING count(*) >= 30""",
    "sentence_lengths": r"""SELECT lang, count(*) AS n, sum(length(s))::BIGINT AS n_chars, max(length(s))::INT AS longest FROM (SELECT lower(trim(lang)) AS lang,
        unnest(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')) AS s FROM documents) GROUP BY 1""",
    "doi_spellings": r"SELECT nullif(lower(regexp_extract(doi, '(10\.\d{4,9}/\S+)', 1)), '') AS doi, count(DISTINCT openalex_id) AS n_ids FROM papers WHERE doi IS NOT NULL GROUP BY 1",
    "slugs": f"""SELECT DISTINCT node_id, CASE WHEN coalesce(trim(label, ' '), '') = '' THEN 'unknown' WHEN s = '' THEN 'x_' || substr(sha1(trim(label, ' ')), 1, 10) ELSE s END AS slug
        FROM (SELECT *, regexp_replace(regexp_replace({_fold("trim(label, ' ')")}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM ingredients)""",
    "years_in_titles": r"SELECT doc_id, n::INT AS number FROM (SELECT doc_id, regexp_extract(translate(text, '−–—', '---'), '(-?\d{1,5})', 1) AS n FROM documents) WHERE n <> ''",
    "keyword_lists": rf"""WITH k AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_extract(text, 'Keywords:([^\n]*)', 1), ';'), lambda x: {_blank('x')}), lambda x: x <> '') AS l FROM documents WHERE contains(text, 'Keywords:'))
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '; ') AS keywords FROM k""",
    "lexicon_ratio": f"SELECT doc_id, coalesce(t, 0)::INT AS talk, coalesce(p, 0)::INT AS practice, round(CASE WHEN t > 0 THEN p::DOUBLE / t END, 8) AS ratio FROM (SELECT doc_id, {_lex(TALK)} AS t, {_lex(PRACTICE)} AS p FROM documents)",
    "lexicon_terms": f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower({_blank('text')}), '\\b({'|'.join(TALK + PRACTICE)})\\b')) AS term FROM documents) GROUP BY 1",
    "sector_hits": """SELECT coalesce(nullif(lower(trim(source)), ''), '(none)') AS source, count(*) AS n, """ + ", ".join(f"round(100 * avg((coalesce(regexp_matches(text, '{p}'), false))::INT), 8) AS {n}" for n, p in {"energy": "energy|battery|heat", "food": "food|recipe|cream", "textile": "textile|fibre"}.items()) + " FROM documents GROUP BY 1",
    "context_words": f"""WITH w AS (SELECT {_words('text', 1, False)} AS w FROM documents), a AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w),
        t AS (SELECT unnest(w[greatest(1, i - 10):i + 10]) AS t FROM a WHERE w[i] = 'compost')
        SELECT t, count(*) AS n FROM t WHERE length(t) >= 3 AND t NOT IN ({_stop}, 'compost') GROUP BY t HAVING count(*) >= 5""",
    "anagram_labels": f"""WITH l AS (SELECT DISTINCT {_blank(_fold('label'))} AS label FROM ingredients WHERE label IS NOT NULL), k AS (SELECT label, array_to_string(list_sort(string_split(label, ' ')), ' ') AS k FROM l)
        SELECT a.label AS label_a, b.label AS label_b FROM k a JOIN k b USING (k) WHERE a.label < b.label""",
    "stems_and_singulars": f"""WITH w AS (SELECT DISTINCT unnest({_words('label', 3, False)}) AS w FROM ingredients)
        SELECT w, regexp_replace(w, '^([a-z]{{3,}}?)(ingly|edly|ations?|ing|ed|ies|es|s)$', '\\1') AS stem,
        CASE WHEN regexp_matches(w, '[^aeiou]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ch|sh|ss|x|o)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^su]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS singular FROM w""",
    "ontology_grade": f"""WITH l AS (SELECT DISTINCT lower({_blank('label')}) AS label FROM ingredients WHERE label IS NOT NULL), q AS (SELECT label, {_fold('label')} AS f FROM l WHERE label <> ''),
        a AS (SELECT label, f, list_distinct(regexp_extract_all(f, '[a-z]+')) AS a FROM q), b AS (SELECT foodon_id, foodon_label, list_distinct(regexp_extract_all(foodon_label, '[a-z]+')) AS b FROM foodon_terms),
        p AS (SELECT label, foodon_id, f = foodon_label AS same, a, b, len(list_intersect(a, b)) AS m FROM a, b WHERE list_has_any(a, b)),
        g AS (SELECT label, foodon_id, CASE WHEN same THEN 'exact' WHEN m = len(a) AND m = len(b) THEN 'token_set' ELSE 'partial' END AS grade,
            CASE WHEN same THEN 1.0 WHEN m = len(a) AND m = len(b) THEN 0.9 ELSE round(0.45 + 0.3 * (m / (len(a) + len(b) - m)), 8) END::DOUBLE AS confidence FROM p)
        SELECT label, foodon_id, grade, confidence FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, foodon_id) AS rn FROM g) WHERE rn = 1""",
    "ingredient_names": r"SELECT DISTINCT node_id, " + _blank(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + _blank("label") + r"), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '^[\s\d/.,½¼¾-]+', ''), '^(cups?|oz\.?|ounces?|lbs?|pounds?|spoons?|pinch|handful|pints?|quarts?)\s+(of\s+)?', ''), '\s*,.*$', '')") + " AS name FROM ingredients WHERE label IS NOT NULL",
    "plain_pages": r"SELECT doc_id, md5(" + _blank("'Note ' || coalesce(text, '')") + r") AS digest FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[\[\]{}<>|&'']')",
    "placeholders": """SELECT marker, count(*) AS n FROM (SELECT CASE WHEN contains(lower(abstract), 'not provided') THEN 'not provided' WHEN contains(lower(abstract), 'no abstract') THEN 'no abstract'
        WHEN contains(lower(abstract), 'n/a') THEN 'n/a' END AS marker FROM papers) WHERE marker IS NOT NULL GROUP BY 1""",
    "verbatim_titles": f"""SELECT doc_id, bool_or(contains(lower({_blank('text')}), p.title)) AS verbatim FROM documents d JOIN (SELECT DISTINCT upper(trim(openalex_id)) AS k, lower({_blank('title')}) AS title FROM papers WHERE title IS NOT NULL) p
        ON upper(trim(d.paper_id)) = p.k WHERE text IS NOT NULL GROUP BY doc_id""",
    "safe_cells": r"""SELECT doc_id, length(s)::INT AS n, substr(s, 1, 1) AS first FROM (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@]') THEN '''' || t ELSE t END AS s FROM (
        SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g') AS t FROM documents WHERE text IS NOT NULL))""",
    "json_props": "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS n_read, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1",
}
