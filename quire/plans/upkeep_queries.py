"""Queries that keep a corpus in order: worklists, audits, profiles, alignments and features, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.functions.ids import blank_to_null, doi_key
from quire.operators import graph as G
from quire.operators import retrieval as Q
from quire.operators.relational import top_per_group
from quire.plans import curation_queries as K
from quire.plans import measure_queries as M
from quire.plans.graph_queries import concept_pairs
from quire.plans.text_queries import PRACTICE, STOP, TALK
from quire.sources.tables import table
from quire.sources.works import CITATIONS_SQL, WORKS_SQL, citations, works

LEXICON = [*TALK, *PRACTICE]
DOWN = ["energy", "glass", "compost", "water"]


def _n(name="n"):
    return F.count(F.lit(1)).alias(name)


def _decade(c="year"):
    return (F.floor(F.col(c) / 10) * 10).cast("int")


def works_in_years(spark, folder):
    """Works of a range of years with an abstract of some length."""
    return works(spark, folder).where(F.col("year").between(2000, 2020) & (F.length(F.trim("abstract")) >= 50)).select("work", "year")


def cluster_numbers(spark, folder):
    """Clusters' numbers out of their spellings ('10', '10.0', 'C10', 'c10')."""
    c = table(spark, folder, "bridge_candidates").select(F.explode(F.array("cluster_a", "cluster_b")).alias("given"))
    number = F.regexp_extract("given", r"-?\d+", 0).try_cast("int")
    return c.groupBy(number.alias("cluster")).agg(_n(), F.countDistinct("given").alias("n_spellings"))


def resolved_records(spark, folder):
    """Records' works by the first key that finds one: DOI, then title and year."""
    r = table(spark, folder, "scopus_records").where("record_id is not null").groupBy("record_id").agg(F.min(doi_key("doi")).alias("doi"), F.min(F.lower(X.one_blank("title"))).alias("t"), F.min("cover_year").alias("y"))
    w = works(spark, folder).select("work", "doi", F.lower(X.one_blank("title")).alias("t"), F.col("year").alias("y"))
    by_doi = w.where("doi is not null").groupBy("doi").agg(F.min("work").alias("a"))
    by_title = w.where("t is not null and y is not null").groupBy("t", "y").agg(F.min("work").alias("b"))
    how = F.when(F.col("a").isNotNull(), "doi").when(F.col("b").isNotNull(), "title").otherwise("unknown")
    return r.join(by_doi, "doi", "left").join(by_title, ["t", "y"], "left").select("record_id", F.coalesce("a", "b").alias("work"), how.alias("how"))


def aligned_positions(spark, folder):
    """Items of two lists that stand at the same place."""
    w = works(spark, folder).where("size(concepts) > 0 and size(authors) > 0")
    i = F.explode(F.sequence(F.lit(1), F.least(F.size("concepts"), F.size("authors")))).alias("place")
    return w.select("work", "concepts", "authors", i).select("work", "place", F.element_at("concepts", F.col("place")).alias("concept"), F.element_at("authors", F.col("place")).alias("author"))


def long_tokens(spark, folder):
    """Words of Latin letters with accents, of four letters or more, and in how many documents they are."""
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]{4,}"), F.lit(0))
    return table(spark, folder, "documents").select(F.explode(F.array_distinct(t)).alias("token")).groupBy("token").agg(_n("n_docs")).where("n_docs >= 20")


def down_weighted(spark, folder):
    """Texts in which a query's word stays where it first stands and is 'topic' ever after."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.split(F.lower(X.one_blank("text")), " ").alias("w"))
    new = F.transform("w", lambda w, i: F.when(w.isin(DOWN) & (F.array_position(F.col("w"), w) <= i), "topic").otherwise(w))
    x = d.select("doc_id", new.alias("v"))
    return x.select("doc_id", F.size(F.filter("v", lambda v: v == "topic")).alias("n_topic"), F.md5(F.array_join("v", " ")).alias("digest"))


def name_fields(spark, folder):
    """Lists in one field: how many items, and how many different words."""
    r = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max("author_names").alias("a")).where("a is not null")
    items = F.filter(F.transform(F.split("a", ";"), F.trim), lambda x: x != "")
    return r.select("record_id", F.size(items).alias("n_items"), F.size(F.array_distinct(F.regexp_extract_all(F.lower("a"), F.lit("[a-z]+"), F.lit(0)))).alias("n_words"))


def title_branches(spark, folder):
    """Works picked by patterns of the title, unless another pattern rules them out."""
    t = F.lower("title")
    branch = F.when(t.rlike("review|revisiting"), "excluded").when(t.rlike("compost|residue"), "residues").when(t.rlike("glass|slag|clay"), "minerals").otherwise("other")
    return works(spark, folder).groupBy("language", branch.alias("branch")).agg(_n())


def triplet_counts(spark, folder):
    """Triplets kept as JSON arrays, read back and counted by relation."""
    given = F.to_json(F.transform("authorships", lambda a: F.struct(a["author_id"].alias("h"), a["author_position"].alias("r"), F.col("openalex_id").alias("t"))))
    x = table(spark, folder, "papers").select(F.explode(F.from_json(given, "array<struct<h string, r string, t string>>")).alias("x"))
    return x.groupBy(F.col("x.r").alias("relation")).agg(_n(), F.countDistinct("x.h").alias("n_heads"))


def missing_abstracts(spark, folder):
    """The hundred most cited works that lack an abstract, to be fetched first."""
    w = works(spark, folder).where(F.coalesce(F.trim("abstract"), F.lit("")) == "")
    return w.select("work", "citations").orderBy(F.desc_nulls_last("citations"), "work").limit(100)


def audit_trail(spark, folder):
    """What became of each term: merged into another, deleted, or kept."""
    t = table(spark, folder, "bridge_candidates").select(F.explode(F.array("term_a", "term_b")).alias("id")).where("id is not null").distinct()
    p = K.merge_proposals(spark, folder)
    m = p.where("action = 'merge'").groupBy(F.col("merged").alias("id")).agg(F.min("root").alias("root"))
    d = p.where("action = 'discard'").select(F.col("merged").alias("id"), F.lit(True).alias("gone")).distinct()
    status = F.when(F.col("root").isNotNull(), "merged").when(F.col("gone"), "deleted").otherwise("kept")
    return t.join(m, "id", "left").join(d, "id", "left").select("id", status.alias("status"), "root")


def junk_nodes(spark, folder):
    """Terms of discarded pairs: in how many, and on which sides."""
    p = K.merge_proposals(spark, folder).where("action = 'discard'")
    x = p.select(F.explode(F.array(F.struct(F.col("root").alias("id"), F.lit("root").alias("role")), F.struct(F.col("merged").alias("id"), F.lit("merged").alias("role")))).alias("x")).select("x.*")
    return x.groupBy("id").agg(_n("n_pairs"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def retyped_edges(spark, folder):
    """Edges to concepts whose names a rule retypes, by the language of the paper."""
    c = table(spark, folder, "papers").select(F.lower(blank_to_null("language")).alias("language"), F.explode("concepts").alias("c"))
    return c.where(F.lower("c.display_name").rlike("process|waste|food|material")).groupBy("language").agg(_n("n_edges"), F.countDistinct("c.concept_id").alias("n_concepts"))


def cluster_top_concepts(spark, folder):
    """Each cluster's five concepts of most works, in one text."""
    n = works(spark, folder).where("cluster is not null").select("cluster", F.explode("concepts").alias("c")).groupBy("cluster", "c").agg(_n())
    top = top_per_group(n, ["cluster"], [F.desc("n"), F.asc("c")], 5)
    s = F.concat("c", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", s.alias("s")))), lambda x: x["s"]), "; ").alias("concepts"))


def hybrid_edges(spark, folder):
    """A graph of several kinds of edges, counted by kind."""
    w = works(spark, folder)
    kinds = {
        "authored": w.select(F.col("work").alias("s"), F.explode("authors").alias("d")),
        "about": w.select("work", F.explode("concepts")),
        "cites": citations(w).select("src", "dst"),
        "shares": concept_pairs(spark, folder).select("a", "b"),
    }
    out = None
    for kind, e in kinds.items():
        e = e.toDF("s", "d").withColumn("kind", F.lit(kind))
        out = e if out is None else out.union(e)
    return out.groupBy("kind").agg(_n("n_edges"), F.countDistinct("s").alias("n_sources"), F.countDistinct("d").alias("n_targets"))


def character_distances(spark, folder):
    """Jaccard distances of clusters by the concepts that at least two of their works have; of those that share one."""
    p = works(spark, folder).where("cluster is not null").select("cluster", F.explode("concepts").alias("c")).groupBy("cluster", "c").agg(_n()).where("n >= 2").select("cluster", "c")
    s = p.groupBy("cluster").agg(_n("s"))
    both = p.select(F.col("cluster").alias("a"), "c").join(p.select(F.col("cluster").alias("b"), "c"), "c").where("a < b").groupBy("a", "b").agg(_n())
    x = both.join(s.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
    return x.select("a", "b", F.round(1 - F.col("n") / (F.col("sa") + F.col("sb") - F.col("n")), 8).alias("distance"))


def selected_works(spark, folder):
    """Works that meet any of several criteria and have enough concepts: the fifty of most concepts, by year."""
    w = works(spark, folder).where((F.lower("title").contains("compost") | F.col("language").isin("es", "fr") | (F.col("cluster") == 1)) & (F.size("concepts") >= 4) & F.col("year").isNotNull())
    return w.select("work", "year", F.size("concepts").alias("n_concepts")).orderBy(F.desc("n_concepts"), "work").limit(50)


def k_limits(spark, folder):
    """The most groups that a cluster's size allows: at most 20, root of n + 2 and n / 10 + 2."""
    n = works(spark, folder).where("cluster is not null").groupBy("cluster").agg(_n())
    return n.select("cluster", "n", F.least(F.lit(20), F.floor(F.sqrt("n")) + 2, F.floor(F.col("n") / 10) + 2).cast("int").alias("most"))


def axis_overlap(spark, folder):
    """Citing and cited works by the axis on which they share most: concepts, authors or references."""
    w = works(spark, folder)
    axes = ["concepts", "authors", "refs"]
    side = lambda k: w.select(F.col("work").alias(k), *(F.col(a).alias(f"{a}_{k}") for a in axes))

    def jaccard(a):
        n = F.size(F.array_intersect(f"{a}_src", f"{a}_dst"))
        return F.coalesce(F.try_divide(n, F.size(f"{a}_src") + F.size(f"{a}_dst") - n), F.lit(0.0)).alias(a)

    x = citations(w).join(side("src"), "src").join(side("dst"), "dst").select(*(jaccard(a) for a in axes))
    most = F.greatest(*axes)
    winner = F.when(most == 0, "none")
    for a in axes:
        winner = winner.when(F.col(a) == most, a)
    return x.groupBy(winner.alias("winner")).agg(_n(), *(F.round(F.avg(a), 8).alias(f"mean_{a}") for a in axes))


def ranking_gain(spark, folder):
    """How many queries the topical ranking serves better, worse or alike than the lexical one."""
    w, lexical = M._lexical(spark, folder)
    truth = M._truth(w)
    r = lambda x, name: Q.recall_at(x, truth, [10]).select("query", F.col("recall_10").alias(name))
    d = r(lexical, "a").join(r(M._topical(spark, folder), "b"), "query").select((F.col("b") - F.col("a")).alias("d"))
    kind = F.when(F.col("d") > 0, "better").when(F.col("d") < 0, "worse").otherwise("alike")
    return d.groupBy(kind.alias("change")).agg(_n(), F.round(F.avg("d"), 8).alias("mean_change"))


def recall_by_edge(spark, folder):
    """Recall of the lexical ranking for citations within a cluster and across clusters."""
    w, lexical = M._lexical(spark, folder)
    t = G.labelled(M._truth(w).select(F.col("query").alias("src"), F.col("doc").alias("dst")), w, "work", "cluster")
    x = t.join(lexical.select(F.col("query").alias("src"), F.col("doc").alias("dst"), F.lit(1).alias("hit")), ["src", "dst"], "left")
    kind = F.when(F.col("src_label") == F.col("dst_label"), "within").otherwise("across")
    return x.groupBy(kind.alias("kind")).agg(_n("n_true"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 8).alias("recall"))


def expansion_terms(spark, folder):
    """Words that a candidate adds, and how many of them the titles of its other cluster have."""
    b = table(spark, folder, "bridge_candidates").select("candidate_id", F.regexp_extract("cluster_a", r"\d+", 0).try_cast("int").alias("cluster"), F.explode(F.array_distinct(X.words("term_b", 3))).alias("t"))
    known = works(spark, folder).where("cluster is not null").select("cluster", F.explode(X.words("title", 3)).alias("t")).distinct().withColumn("k", F.lit(1))
    return b.join(known, ["cluster", "t"], "left").groupBy("candidate_id").agg(_n("n_terms"), F.count("k").alias("n_kept"))


def author_fields(spark, folder):
    """How the authors' field is filled."""
    a = F.coalesce("authorships", F.array().cast("array<struct<author_id string, author_position string, raw_author_name string>>"))
    x = table(spark, folder, "papers").select("authorships", F.size(a).alias("s"), F.size(F.filter(a, lambda z: z["author_id"].isNull())).alias("i"), F.size(F.filter(a, lambda z: z["raw_author_name"].isNull())).alias("m"))
    return x.agg(_n("n_rows"), F.count_if(F.col("authorships").isNull()).alias("n_null"), F.count_if((F.col("s") == 0) & F.col("authorships").isNotNull()).alias("n_empty"), F.sum("s").alias("n_authors"), F.sum("i").alias("n_without_id"), F.sum("m").alias("n_without_name"))


def records_by_doi(spark, folder):
    """Works whose DOI another source lists, with their lists as text."""
    d = table(spark, folder, "scopus_records").select(doi_key("doi").alias("doi")).where("doi is not null").distinct()
    w = works(spark, folder).join(d, "doi", "left_semi")
    return w.select("work", "doi", F.array_join("authors", "; ").alias("authors"), F.array_join("concepts", "; ").alias("concepts"))


def term_network(spark, folder):
    """The hundred most cited works with one of some terms in the title, with their neighbours as text."""
    t = F.lower("title")
    w = works(spark, folder).where(t.contains("compost") | t.contains("glass"))
    return w.select("work", F.coalesce("citations", F.lit(0)).alias("citations"), F.array_join("authors", ";").alias("authors"), F.array_join("refs", ";").alias("refs")).orderBy(F.desc("citations"), "work").limit(100)


def representative_names(spark, folder):
    """Papers by the first of their concepts' names, and whether any name has a word."""
    names = F.array_sort(F.array_distinct(F.filter(F.transform("concepts", lambda c: F.lower(X.one_blank(c["display_name"]))), lambda n: n.isNotNull() & (n != ""))))
    x = table(spark, folder, "papers").select(names.alias("n")).where("size(n) > 0")
    return x.groupBy(F.element_at("n", 1).alias("first"), F.exists("n", lambda n: n.contains("waste")).alias("any_waste")).agg(_n())


def title_classes(spark, folder):
    """Works by the first of some patterns that their title has."""
    t = F.lower("title")
    kind = F.when(t.isNull(), "untitled").when(t.rlike("review|revisiting"), "review").when(t.rlike("compar"), "comparison").when(t.rlike("how |why "), "question").otherwise("other")
    return works(spark, folder).groupBy(kind.alias("kind")).agg(_n(), F.round(F.avg("citations"), 8).alias("mean_citations"))


def analysis_rows(spark, folder):
    """Documents of known works with counts of words and of a lexicon's words."""
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.upper(F.trim("paper_id")).alias("work"), X.words("text", 1).alias("w"))
    return d.join(works(spark, folder).select("work", "year", "cluster"), "work").select("doc_id", "work", "year", "cluster", F.size("w").alias("n_words"), F.size(F.filter("w", lambda x: x.isin(LEXICON))).alias("n_lexicon"))


def language_coverage(spark, folder):
    """Shares of works and of citations by language, unknown ones apart."""
    w = works(spark, folder).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(_n(), F.coalesce(F.sum("citations"), F.lit(0)).alias("c"))
    t = w.agg(F.sum("n").alias("tn"), F.sum("c").alias("tc"))
    return w.crossJoin(F.broadcast(t)).select("language", "n", F.round(F.col("n") / F.col("tn"), 8).alias("share"), F.round(F.try_divide(F.col("c"), F.col("tc")), 8).alias("weighted_share"))  # one row


def share_or_ratio(spark, folder):
    """Per cluster, the mean over decades of the share of open works, and the ratio of the sums."""
    w = works(spark, folder).where("cluster is not null and year is not null and is_oa is not null")
    g = w.groupBy("cluster", _decade().alias("d")).agg(_n(), F.count_if("is_oa").alias("k"))
    return g.groupBy("cluster").agg(F.round(F.avg(F.col("k") / F.col("n")), 8).alias("mean_share"), F.round(F.sum("k") / F.sum("n"), 8).alias("ratio"))


def term_modes(spark, folder):
    """A lexicon's words in each document: all of them, and different ones."""
    d = table(spark, folder, "documents").select("doc_id", F.filter(X.words("text", 3), lambda w: w.isin(LEXICON)).alias("w")).where("size(w) > 0")
    return d.select("doc_id", F.size("w").alias("n_total"), F.size(F.array_distinct("w")).alias("n_distinct"))


def below_best(spark, folder):
    """How far each cluster's mean citations lie below the best cluster's."""
    w = works(spark, folder).where("cluster is not null").groupBy("cluster").agg(F.avg("citations").alias("m"))
    best = w.agg(F.max("m").alias("b"))
    return w.crossJoin(F.broadcast(best)).select("cluster", F.round("m", 8).alias("mean"), F.round(F.col("b") - F.col("m"), 8).alias("deficit"))  # one row


def top_concepts_by_type(spark, folder):
    """Per cluster and type the five concepts of most works since 2010, works of unknown year too."""
    w = works(spark, folder).where("cluster is not null and type is not null and (year is null or year >= 2010)")
    n = w.select("cluster", "type", F.explode("concepts").alias("concept")).groupBy("cluster", "type", "concept").agg(_n())
    return top_per_group(n, ["cluster", "type"], [F.desc("n"), F.asc("concept")], 5)


def aligned_corpus(spark, folder):
    """Works that have an abstract, a vector and a record of the second source, with the record."""
    w = works(spark, folder).where("trim(abstract) <> '' and doi is not null").select("work", "doi")
    v = table(spark, folder, "abstract_vectors").where("size(vector) = 384").select(F.col("node_id").alias("work")).distinct()
    s = table(spark, folder, "scopus_records").select("record_id", doi_key("doi").alias("doi")).where("doi is not null").distinct()
    return w.join(v, "work", "left_semi").join(s, "doi").select("work", "record_id")


def labelled_texts(spark, folder):
    """Fields of a work in one text, each under its name, with a mark for what is missing."""
    part = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")))
    return works(spark, folder).select("work", F.md5(F.concat_ws(" | ", part("title"), part("year"), part("type"), part("language"))).alias("digest"))


def retry_list(spark, folder):
    """Candidates that a judge has at some time not answered readably: how often it was tried, and how often it could be read."""
    j = table(spark, folder, "judgements").select("candidate_id", F.lower(F.trim("judge")).alias("judge"), F.coalesce("parse_ok", F.lit(False)).alias("ok")).where("judge <> ''")
    return j.groupBy("candidate_id", "judge").agg(_n("n_tries"), F.count_if("ok").alias("n_read")).where("n_read < n_tries")


def refreshed_years(spark, folder):
    """Records' years, from the work of the same DOI where it has one."""
    r = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max(doi_key("doi")).alias("doi"), F.max("cover_year").alias("given"))
    w = works(spark, folder).where("doi is not null").groupBy("doi").agg(F.max("year").alias("year"))
    return r.join(w, "doi", "left").select("record_id", F.coalesce("year", "given").alias("year"), F.coalesce(F.col("year") != F.col("given"), F.lit(False)).alias("changed"))


def listed_items(spark, folder):
    """Items of lists with several separators, by whether they can be used."""
    x = table(spark, folder, "scopus_records").select(F.explode(F.split("author_names", "[;|]")).alias("x")).select(F.trim("x").alias("x"))
    why = F.when(F.col("x") == "", "empty").when(~F.lower("x").rlike("[a-z]{2}"), "no name").when(F.lower("x").rlike("et al"), "more").otherwise("good")
    return x.groupBy(why.alias("reason")).agg(_n(), F.countDistinct("x").alias("n_distinct"))


def concept_context(spark, folder):
    """Each concept's works, most frequent language and three most frequent decades."""
    w = works(spark, folder).select("language", _decade().alias("d"), F.explode("concepts").alias("concept"))
    n = w.groupBy("concept").agg(_n("n_works"))
    lang = w.where("language is not null").groupBy("concept", "language").agg(_n()).groupBy("concept").agg(F.min(F.struct(-F.col("n"), F.col("language")))["language"].alias("language"))
    dec = top_per_group(w.where("d is not null").groupBy("concept", "d").agg(_n()), ["concept"], [F.desc("n"), F.asc("d")], 3)
    dec = dec.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda x: x["d"].cast("string")), ", ").alias("decades"))
    return n.join(lang, "concept", "left").join(dec, "concept", "left")


def link_hosts(spark, folder):
    """Hosts that the documents link to."""
    h = F.regexp_extract_all(F.lower("text"), F.lit(r"https?://([a-z0-9.-]+)"), F.lit(1))
    return table(spark, folder, "documents").select("doc_id", F.explode(h).alias("host")).groupBy("host").agg(_n("n_links"), F.countDistinct("doc_id").alias("n_docs"))


def instruction_lines(spark, folder):
    """Lines of each source that read like an instruction."""
    d = table(spark, folder, "documents").select(F.lower(blank_to_null("source")).alias("source"), F.explode(F.split("text", r"\n")).alias("l")).select("source", F.regexp_replace("l", "^[ \t\r]+|[ \t\r]+$", "").alias("l")).where("l <> ''")
    return d.groupBy("source").agg(_n("n_lines"), F.count_if(F.lower("l").rlike(r"^(\d+[.)] *)?(add|mix|stir|bake|boil|heat|cut|take|place|see) ")).alias("n_instructions"))


def extraction_targets(spark, folder):
    """Documents to be read again, and why the others aren't."""
    n = F.length(F.trim("text"))
    why = F.when(F.col("text").isNull(), "no text").when(n < 200, "short").when(n > 20000, "long").when(F.col("paper_id").isNotNull(), "known").otherwise("target")
    return table(spark, folder, "documents").groupBy(F.lower(blank_to_null("source")).alias("source"), why.alias("reason")).agg(_n())


def contamination(spark, folder):
    """Documents of each source with a placeholder, few words, or no word of their paper's title."""
    t = works(spark, folder).select("work", F.array_distinct(X.words("title", 4, STOP)).alias("t"))
    d = table(spark, folder, "documents").select(F.lower(blank_to_null("source")).alias("source"), F.upper(F.trim("paper_id")).alias("work"), F.lower("text").alias("x"), F.coalesce(X.words("text", 1), F.array().cast("array<string>")).alias("w"))
    x = d.join(t, "work", "left")
    none = F.col("t").isNotNull() & (F.size("t") > 0) & (F.size(F.array_intersect("t", "w")) == 0)
    return x.groupBy("source").agg(_n("n_docs"), F.count_if(F.coalesce(F.col("x").rlike("not provided|no abstract|lorem ipsum"), F.lit(False))).alias("n_placeholder"), F.count_if(F.size("w") < 20).alias("n_short"), F.count_if(none).alias("n_foreign"))


def applied_flags(spark, folder):
    """Flags set where none was, kept where one was, with what was done."""
    i = table(spark, folder, "ingredients").where("node_id is not null").groupBy("node_id").agg(F.max("ner_noise_flag").alias("had"), F.max(F.coalesce(F.lower("label").rlike(r"\d|\bsee\b|note"), F.lit(False))).alias("found"))
    action = F.when(F.col("had").isNotNull() & (F.col("had") == F.col("found")), "same").when(F.col("had").isNotNull(), "kept").when(F.col("found"), "set").otherwise("cleared")
    return i.select("node_id", F.coalesce("had", "found").alias("flag"), action.alias("action"))


def single_leaf(spark, folder):
    """Every name's one entry, the smallest of several."""
    t = table(spark, folder, "foodon_terms")
    x = t.select(F.col("foodon_label").alias("name"), "foodon_id").union(t.select(F.explode("alt_labels"), "foodon_id")).where("name is not null")
    return x.groupBy(F.lower(X.one_blank("name")).alias("name")).agg(F.min("foodon_id").alias("foodon_id"), F.countDistinct("foodon_id").alias("n_entries"))


def feature_tokens(spark, folder):
    """Works' features of several kinds, each with its kind's mark, by the number of works."""
    w = works(spark, folder)
    mark = lambda k, c: F.transform(c, lambda x: F.concat(F.lit(f"{k}:"), x))
    one = lambda k, c: F.filter(F.array(F.concat(F.lit(f"{k}:"), F.col(c))), lambda x: x.isNotNull())
    f = F.concat(mark("concept", "concepts"), mark("author", "authors"), one("type", "type"), one("language", "language"))
    return w.select(F.explode(f).alias("feature")).groupBy("feature").agg(_n("n_works")).where("n_works >= 3")


def lineage_works(spark, folder):
    """Works kept for a lineage: all of one language, of the others those whose title has a word and none of another."""
    t = F.coalesce(F.lower("title"), F.lit(""))
    keep = (F.col("language") == "es") | (F.col("language").isin("en", "fr") & t.rlike("compost|glass|waste") & ~t.rlike("review"))
    return works(spark, folder).where(keep).select("work", "language")


def vector_counts(spark, folder):
    """Works with an abstract and those of them with a vector, by cluster."""
    w = works(spark, folder).where("trim(abstract) <> ''").select("work", "cluster")
    v = table(spark, folder, "abstract_vectors").where("size(vector) = 384").select(F.col("node_id").alias("work"), F.lit(1).alias("k")).distinct()
    x = w.join(v, "work", "left").groupBy("cluster").agg(_n("n_expected"), F.count("k").alias("n_found"))
    return x.withColumn("complete", F.col("n_expected") == F.col("n_found"))


def venue_words(spark, folder):
    """Records with each of their venue's parts, records without a venue too."""
    r = table(spark, folder, "scopus_records").groupBy("record_id").agg(F.max("source_title").alias("s"))
    parts = F.array_distinct(F.filter(F.transform(F.split(F.lower("s"), r"[ |]"), F.trim), lambda x: x != ""))
    return r.select("record_id", F.explode_outer(parts).alias("part"))


def cleaned_abstracts(spark, folder):
    """Abstracts without boilerplate, with one spelling of some words, in one line."""
    t = F.lower("abstract")
    for pattern, instead in CLEANING:
        t = F.regexp_replace(t, pattern, instead)
    t = X.one_blank(t)
    return works(spark, folder).where("abstract is not null").select("work", F.length(t).alias("n"), F.md5(t).alias("digest"))


CLEANING = [
    (r"https?://[^ ]+", " "), (r"<[^>]+>", " "), (r"\(c\) *[0-9]{4}", " "), ("©", " "), ("all rights reserved", " "), ("published by [a-z]+", " "), (r"copyright [0-9]{4}", " "), ("open access", " "),
    (r"\b(abstract|background|objectives?|methods?|results?|conclusions?) *: ", " "), (r"doi: *[^ ]+", " "), ("key ?words *:.*", " "), (r"\b(fig|figure|table) *[0-9]+", " "), ("behaviour", "behavior"),
    ("colour", "color"), ("fibre", "fiber"), ("analyse", "analyze"), ("optimis", "optimiz"), ("stabilis", "stabiliz"), (r"et al\.?", " "), (r"\[[0-9, ]+\]", " "), (r"[\"“”]", " "), ("n/a", " "), ("not provided", " "), ("no abstract", " "),
]


def tri_state_flags(spark, folder):
    """Flags as text, read as true, false or unknown."""
    t = F.lower(F.trim(F.col("ner_noise_flag").cast("string")))
    state = F.when(t.isin("true", "1", "yes", "y"), "true").when(t.isin("false", "0", "no", "n"), "false").otherwise("unknown")
    return table(spark, folder, "ingredients").groupBy(state.alias("state")).agg(_n(), F.countDistinct("node_id").alias("n_nodes"))


QUERIES = {f.__name__: f for f in (
    works_in_years, cluster_numbers, resolved_records, aligned_positions, long_tokens, down_weighted, name_fields, title_branches, triplet_counts, missing_abstracts, audit_trail, junk_nodes,
    retyped_edges, cluster_top_concepts, hybrid_edges, character_distances, selected_works, k_limits, axis_overlap, ranking_gain, recall_by_edge, expansion_terms, author_fields, records_by_doi,
    term_network, representative_names, title_classes, analysis_rows, language_coverage, share_or_ratio, term_modes, below_best, top_concepts_by_type, aligned_corpus, labelled_texts, retry_list,
    refreshed_years, listed_items, concept_context, link_hosts, instruction_lines, extraction_targets, contamination, applied_flags, single_leaf, feature_tokens, lineage_works, vector_counts,
    venue_words, cleaned_abstracts, tri_state_flags)}

_W = "WITH " + WORKS_SQL
_b = lambda c: rf"trim(regexp_replace({c}, '[ \t\r\n]+', ' ', 'g'), ' ')"
_doi = r"nullif(lower(regexp_extract(doi, '(10\.\d{4,9}/\S+)', 1)), '')"
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_words = lambda c, least, stop=(): f"list_filter(regexp_extract_all(lower({c}), '[a-z]+'), lambda w: length(w) >= {least}{f' AND w NOT IN ({_list(stop)})' if stop else ''})"
_src = lambda c: f"nullif(lower(trim({c})), '')"
# terms of the whole abstract: words and neighbouring pairs; nothing left out
_TERMS = _W + f""", aw AS (SELECT work AS id, {_words('abstract', 3, STOP)} AS w FROM works),
    t AS (SELECT DISTINCT id, unnest(list_concat(w, list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM aw), q AS (SELECT * FROM t WHERE substr(id, 2)::BIGINT % 20 = 0),
    lex AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT q.id AS query, t.id AS doc, count(*) AS score FROM q JOIN t USING (term) WHERE q.id <> t.id GROUP BY ALL)) WHERE place <= 10),
    c AS (SELECT work AS id, unnest(concepts) AS term FROM works),
    top AS (SELECT query, doc FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM (SELECT a.id AS query, b.id AS doc, count(*) AS score FROM c a JOIN c b USING (term) WHERE a.id <> b.id AND substr(a.id, 2)::BIGINT % 20 = 0 GROUP BY ALL)) WHERE place <= 10),
    {CITATIONS_SQL}, truth AS (SELECT src AS query, dst AS doc FROM cites WHERE substr(src, 2)::BIGINT % 20 = 0)"""


def _nested(c):
    for pattern, instead in CLEANING:
        c = f"regexp_replace({c}, '{pattern}', '{instead}', 'g')"
    return _b(c)


_JAC = lambda a: f"coalesce(len(list_intersect(s.{a}, d.{a})) / nullif(len(s.{a}) + len(d.{a}) - len(list_intersect(s.{a}, d.{a})), 0), 0)"

SQL = {
    "works_in_years": _W + " SELECT work, year FROM works WHERE year BETWEEN 2000 AND 2020 AND length(trim(abstract)) >= 50",
    "cluster_numbers": r"SELECT try_cast(regexp_extract(given, '-?\d+', 0) AS INT) AS cluster, count(*) AS n, count(DISTINCT given) AS n_spellings FROM (SELECT unnest([cluster_a, cluster_b]) AS given FROM bridge_candidates) GROUP BY 1",
    "resolved_records": _W + f""", r AS (SELECT record_id, min({_doi}) AS doi, min(lower({_b('title')})) AS t, min(cover_year) AS y FROM scopus_records WHERE record_id IS NOT NULL GROUP BY 1), a AS (SELECT doi, min(work) AS a FROM works WHERE doi IS NOT NULL GROUP BY 1),
        b AS (SELECT lower({_b('title')}) AS t, year AS y, min(work) AS b FROM works WHERE title IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2)
        SELECT record_id, coalesce(a, b) AS work, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'title' ELSE 'unknown' END AS how FROM r LEFT JOIN a ON a.doi = r.doi LEFT JOIN b ON b.t = r.t AND b.y = r.y""",
    "aligned_positions": _W + " SELECT work, place::INT AS place, concepts[place] AS concept, authors[place] AS author FROM (SELECT work, concepts, authors, unnest(range(1, least(len(concepts), len(authors)) + 1)) AS place FROM works)",
    "long_tokens": "SELECT token, count(*) AS n_docs FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]{4,}'))) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 20",
    "down_weighted": f"""WITH d AS (SELECT doc_id, string_split(lower({_b('text')}), ' ') AS w FROM documents WHERE text IS NOT NULL),
        v AS (SELECT doc_id, list_transform(list_zip(w, range(len(w))), lambda z: CASE WHEN z[1] IN ({_list(DOWN)}) AND list_position(w, z[1]) <= z[2] THEN 'topic' ELSE z[1] END) AS v FROM d)
        SELECT doc_id, len(list_filter(v, lambda x: x = 'topic'))::INT AS n_topic, md5(array_to_string(v, ' ')) AS digest FROM v""",
    "name_fields": """SELECT record_id, len(list_filter(list_transform(string_split(a, ';'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n_items, len(list_distinct(regexp_extract_all(lower(a), '[a-z]+')))::INT AS n_words
        FROM (SELECT record_id, max(author_names) AS a FROM scopus_records GROUP BY 1) WHERE a IS NOT NULL""",
    "title_branches": _W + """ SELECT language, CASE WHEN regexp_matches(lower(title), 'review|revisiting') THEN 'excluded' WHEN regexp_matches(lower(title), 'compost|residue') THEN 'residues' WHEN regexp_matches(lower(title), 'glass|slag|clay') THEN 'minerals' ELSE 'other' END AS branch, count(*) AS n
        FROM works GROUP BY 1, 2""",
    "triplet_counts": "SELECT a.author_position AS relation, count(*) AS n, count(DISTINCT a.author_id) AS n_heads FROM (SELECT unnest(authorships) AS a FROM papers) GROUP BY 1",
    "missing_abstracts": _W + " SELECT work, citations FROM works WHERE coalesce(trim(abstract), '') = '' ORDER BY citations DESC NULLS LAST, work LIMIT 100",
    "audit_trail": K._PROP + """, t AS (SELECT DISTINCT unnest([term_a, term_b]) AS id FROM bridge_candidates), m AS (SELECT merged AS id, min(root) AS root FROM prop WHERE action = 'merge' GROUP BY 1), d AS (SELECT DISTINCT merged AS id FROM prop WHERE action = 'discard')
        SELECT id, CASE WHEN root IS NOT NULL THEN 'merged' WHEN id IN (SELECT id FROM d) THEN 'deleted' ELSE 'kept' END AS status, root FROM t LEFT JOIN m USING (id) WHERE id IS NOT NULL""",
    "junk_nodes": K._PROP + """, sides AS (SELECT root AS id, 'root' AS role FROM prop WHERE action = 'discard' UNION ALL SELECT merged, 'merged' FROM prop WHERE action = 'discard')
        SELECT id, count(*) AS n_pairs, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM sides GROUP BY 1""",
    "retyped_edges": f"""SELECT language, count(*) AS n_edges, count(DISTINCT c.concept_id) AS n_concepts FROM (SELECT {_src('language')} AS language, unnest(concepts) AS c FROM papers) WHERE regexp_matches(lower(c.display_name), 'process|waste|food|material') GROUP BY 1""",
    "cluster_top_concepts": _W + """, n AS (SELECT cluster, c, count(*) AS n FROM (SELECT cluster, unnest(concepts) AS c FROM works WHERE cluster IS NOT NULL) GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c) AS place FROM n)
        SELECT cluster, string_agg(c || ' (' || n || ')', '; ' ORDER BY place) AS concepts FROM p WHERE place <= 5 GROUP BY 1""",
    "hybrid_edges": _W + f""", {CITATIONS_SQL}, k AS (SELECT work, unnest(concepts) AS c FROM works),
        e AS (SELECT 'authored' AS kind, work AS s, unnest(authors) AS d FROM works UNION ALL SELECT 'about', work, c FROM k UNION ALL SELECT 'cites', src, dst FROM cites
            UNION ALL SELECT 'shares', a, b FROM (SELECT x.c AS a, y.c AS b FROM k x JOIN k y ON x.work = y.work AND x.c < y.c GROUP BY ALL HAVING count(*) >= 3))
        SELECT kind, count(*) AS n_edges, count(DISTINCT s) AS n_sources, count(DISTINCT d) AS n_targets FROM e GROUP BY 1""",
    "character_distances": _W + """, p AS (SELECT cluster, c FROM (SELECT cluster, unnest(concepts) AS c FROM works WHERE cluster IS NOT NULL) GROUP BY ALL HAVING count(*) >= 2), s AS (SELECT cluster, count(*) AS s FROM p GROUP BY 1)
        SELECT a, b, round(1 - n / (sa.s + sb.s - n), 8) AS distance FROM (SELECT x.cluster AS a, y.cluster AS b, count(*) AS n FROM p x JOIN p y ON x.c = y.c AND x.cluster < y.cluster GROUP BY ALL) JOIN s sa ON sa.cluster = a JOIN s sb ON sb.cluster = b""",
    "selected_works": _W + " SELECT work, year, len(concepts)::INT AS n_concepts FROM works WHERE (contains(lower(title), 'compost') OR language IN ('es', 'fr') OR cluster = 1) AND len(concepts) >= 4 AND year IS NOT NULL ORDER BY n_concepts DESC, work LIMIT 50",
    "k_limits": _W + " SELECT cluster, count(*) AS n, least(20, floor(sqrt(count(*))) + 2, floor(count(*) / 10) + 2)::INT AS most FROM works WHERE cluster IS NOT NULL GROUP BY 1",
    "axis_overlap": _W + f""", {CITATIONS_SQL}, x AS (SELECT {_JAC('concepts')} AS c, {_JAC('authors')} AS a, {_JAC('refs')} AS r FROM cites JOIN works s ON s.work = src JOIN works d ON d.work = dst)
        SELECT CASE WHEN greatest(c, a, r) = 0 THEN 'none' WHEN c = greatest(c, a, r) THEN 'concepts' WHEN a = greatest(c, a, r) THEN 'authors' ELSE 'refs' END AS winner, count(*) AS n, round(avg(c), 8) AS mean_concepts, round(avg(a), 8) AS mean_authors, round(avg(r), 8) AS mean_refs FROM x GROUP BY 1""",
    "ranking_gain": _TERMS + """, d AS (SELECT query, count(p.doc) / count(*) - count(l.doc) / count(*) AS d FROM truth LEFT JOIN lex l USING (query, doc) LEFT JOIN top p USING (query, doc) GROUP BY query)
        SELECT CASE WHEN d > 0 THEN 'better' WHEN d < 0 THEN 'worse' ELSE 'alike' END AS change, count(*) AS n, round(avg(d), 8) AS mean_change FROM d GROUP BY 1""",
    "recall_by_edge": _TERMS + """ SELECT CASE WHEN s.cluster = d.cluster THEN 'within' ELSE 'across' END AS kind, count(*) AS n_true, count(l.doc) AS hits, round(count(l.doc) / count(*), 8) AS recall
        FROM truth JOIN works s ON s.work = query JOIN works d ON d.work = truth.doc LEFT JOIN lex l ON l.query = truth.query AND l.doc = truth.doc WHERE s.cluster IS NOT NULL AND d.cluster IS NOT NULL GROUP BY 1""",
    "expansion_terms": _W + rf""", b AS (SELECT candidate_id, try_cast(regexp_extract(cluster_a, '\d+', 0) AS INT) AS cluster, unnest(list_distinct({_words('term_b', 3)})) AS t FROM bridge_candidates), k AS (SELECT DISTINCT cluster, unnest({_words('title', 3)}) AS t FROM works WHERE cluster IS NOT NULL)
        SELECT candidate_id, count(*) AS n_terms, count(k.t) AS n_kept FROM b LEFT JOIN k ON k.cluster = b.cluster AND k.t = b.t GROUP BY 1""",
    "author_fields": """SELECT count(*) AS n_rows, count(*) FILTER (authorships IS NULL) AS n_null, count(*) FILTER (len(authorships) = 0) AS n_empty, sum(coalesce(len(authorships), 0))::BIGINT AS n_authors,
        sum(coalesce(len(list_filter(authorships, lambda z: z.author_id IS NULL)), 0))::BIGINT AS n_without_id, sum(coalesce(len(list_filter(authorships, lambda z: z.raw_author_name IS NULL)), 0))::BIGINT AS n_without_name FROM papers""",
    "records_by_doi": _W + f" SELECT work, doi, array_to_string(authors, '; ') AS authors, array_to_string(concepts, '; ') AS concepts FROM works WHERE doi IN (SELECT {_doi} FROM scopus_records)",
    "term_network": _W + " SELECT work, coalesce(citations, 0) AS citations, array_to_string(authors, ';') AS authors, array_to_string(refs, ';') AS refs FROM works WHERE contains(lower(title), 'compost') OR contains(lower(title), 'glass') ORDER BY coalesce(citations, 0) DESC, work LIMIT 100",
    "representative_names": f"""SELECT n[1] AS first, len(list_filter(n, lambda x: contains(x, 'waste'))) > 0 AS any_waste, count(*) AS n FROM (SELECT list_sort(list_distinct(list_filter(list_transform(concepts, lambda c: lower({_b('c.display_name')})), lambda x: x IS NOT NULL AND x <> ''))) AS n FROM papers)
        WHERE len(n) > 0 GROUP BY 1, 2""",
    "title_classes": _W + """ SELECT CASE WHEN title IS NULL THEN 'untitled' WHEN regexp_matches(lower(title), 'review|revisiting') THEN 'review' WHEN regexp_matches(lower(title), 'compar') THEN 'comparison' WHEN regexp_matches(lower(title), 'how |why ') THEN 'question' ELSE 'other' END AS kind,
        count(*) AS n, round(avg(citations), 8) AS mean_citations FROM works GROUP BY 1""",
    "analysis_rows": _W + f""", d AS (SELECT doc_id, upper(trim(paper_id)) AS work, {_words('text', 1)} AS w FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, work, year, cluster, len(w)::INT AS n_words, len(list_filter(w, lambda x: x IN ({_list(LEXICON)})))::INT AS n_lexicon FROM d JOIN works USING (work)""",
    "language_coverage": _W + """, g AS (SELECT coalesce(language, 'unknown') AS language, count(*) AS n, coalesce(sum(citations), 0) AS c FROM works GROUP BY 1)
        SELECT language, n, round(n / sum(n) OVER (), 8) AS share, round(c / nullif(sum(c) OVER (), 0), 8) AS weighted_share FROM g""",
    "share_or_ratio": _W + """, g AS (SELECT cluster, year // 10 AS d, count(*) AS n, count(*) FILTER (is_oa) AS k FROM works WHERE cluster IS NOT NULL AND year IS NOT NULL AND is_oa IS NOT NULL GROUP BY 1, 2)
        SELECT cluster, round(avg(k / n), 8) AS mean_share, round(sum(k) / sum(n), 8) AS ratio FROM g GROUP BY 1""",
    "term_modes": f"SELECT doc_id, len(w)::INT AS n_total, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ({_list(LEXICON)})) AS w FROM documents) WHERE len(w) > 0",
    "below_best": _W + ", m AS (SELECT cluster, avg(citations) AS m FROM works WHERE cluster IS NOT NULL GROUP BY 1) SELECT cluster, round(m, 8) AS mean, round(max(m) OVER () - m, 8) AS deficit FROM m",
    "top_concepts_by_type": _W + """, n AS (SELECT cluster, type, concept, count(*) AS n FROM (SELECT cluster, type, unnest(concepts) AS concept FROM works WHERE cluster IS NOT NULL AND type IS NOT NULL AND (year IS NULL OR year >= 2010)) GROUP BY ALL)
        SELECT cluster, type, concept, n, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster, type ORDER BY n DESC, concept) AS place FROM n) WHERE place <= 5""",
    "aligned_corpus": _W + f""" SELECT DISTINCT work, record_id FROM works JOIN (SELECT record_id, {_doi} AS doi FROM scopus_records) s USING (doi) WHERE trim(abstract) <> '' AND work IN (SELECT node_id FROM abstract_vectors WHERE len(vector) = 384)""",
    "labelled_texts": _W + " SELECT work, md5('title: ' || coalesce(title, 'n/a') || ' | year: ' || coalesce(year::VARCHAR, 'n/a') || ' | type: ' || coalesce(type, 'n/a') || ' | language: ' || coalesce(language, 'n/a')) AS digest FROM works",
    "retry_list": "SELECT candidate_id, lower(trim(judge)) AS judge, count(*) AS n_tries, count(*) FILTER (parse_ok) AS n_read FROM judgements WHERE trim(judge) <> '' GROUP BY 1, 2 HAVING count(*) FILTER (parse_ok) < count(*)",
    "refreshed_years": _W + f""", r AS (SELECT record_id, max({_doi}) AS doi, max(cover_year) AS given FROM scopus_records GROUP BY 1), y AS (SELECT doi, max(year) AS year FROM works WHERE doi IS NOT NULL GROUP BY 1)
        SELECT record_id, coalesce(year, given) AS year, coalesce(year <> given, false) AS changed FROM r LEFT JOIN y ON y.doi = r.doi""",
    "listed_items": """SELECT CASE WHEN x = '' THEN 'empty' WHEN NOT regexp_matches(lower(x), '[a-z]{2}') THEN 'no name' WHEN regexp_matches(lower(x), 'et al') THEN 'more' ELSE 'good' END AS reason, count(*) AS n, count(DISTINCT x) AS n_distinct
        FROM (SELECT trim(x) AS x FROM (SELECT unnest(regexp_split_to_array(author_names, '[;|]')) AS x FROM scopus_records)) GROUP BY 1""",
    "concept_context": _W + """, w AS (SELECT language, year // 10 * 10 AS d, unnest(concepts) AS concept FROM works), l AS (SELECT concept, language, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, language) AS place FROM w WHERE language IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT concept, d, row_number() OVER (PARTITION BY concept ORDER BY count(*) DESC, d) AS place FROM w WHERE d IS NOT NULL GROUP BY 1, 2)
        SELECT concept, n_works, language, decades FROM (SELECT concept, count(*) AS n_works FROM w GROUP BY 1) LEFT JOIN (SELECT concept, language FROM l WHERE place = 1) USING (concept)
        LEFT JOIN (SELECT concept, string_agg(d::VARCHAR, ', ' ORDER BY place) AS decades FROM e WHERE place <= 3 GROUP BY 1) USING (concept)""",
    "link_hosts": "SELECT host, count(*) AS n_links, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), 'https?://([a-z0-9.-]+)', 1)) AS host FROM documents) GROUP BY 1",
    "instruction_lines": rf"""SELECT source, count(*) AS n_lines, count(*) FILTER (regexp_matches(lower(l), '^(\d+[.)] *)?(add|mix|stir|bake|boil|heat|cut|take|place|see) ')) AS n_instructions
        FROM (SELECT {_src('source')} AS source, regexp_replace(l, '^[ \t\r]+|[ \t\r]+$', '', 'g') AS l FROM (SELECT source, unnest(string_split(text, chr(10))) AS l FROM documents)) WHERE l <> '' GROUP BY 1""",
    "extraction_targets": f"""SELECT {_src('source')} AS source, CASE WHEN text IS NULL THEN 'no text' WHEN length(trim(text)) < 200 THEN 'short' WHEN length(trim(text)) > 20000 THEN 'long' WHEN paper_id IS NOT NULL THEN 'known' ELSE 'target' END AS reason, count(*) AS n FROM documents GROUP BY 1, 2""",
    "contamination": _W + f""", d AS (SELECT {_src('source')} AS source, upper(trim(paper_id)) AS work, lower(text) AS x, coalesce({_words('text', 1)}, []) AS w FROM documents), t AS (SELECT work, list_distinct({_words('title', 4, STOP)}) AS t FROM works)
        SELECT source, count(*) AS n_docs, count(*) FILTER (coalesce(regexp_matches(x, 'not provided|no abstract|lorem ipsum'), false)) AS n_placeholder, count(*) FILTER (len(w) < 20) AS n_short, count(*) FILTER (len(t) > 0 AND len(list_intersect(t, w)) = 0) AS n_foreign FROM d LEFT JOIN t USING (work) GROUP BY 1""",
    "applied_flags": r"""SELECT node_id, coalesce(had, found) AS flag, CASE WHEN had IS NOT NULL AND had = found THEN 'same' WHEN had IS NOT NULL THEN 'kept' WHEN found THEN 'set' ELSE 'cleared' END AS action
        FROM (SELECT node_id, bool_or(ner_noise_flag) AS had, bool_or(coalesce(regexp_matches(lower(label), '\d|\bsee\b|note'), false)) AS found FROM ingredients WHERE node_id IS NOT NULL GROUP BY 1)""",
    "single_leaf": f"SELECT lower({_b('name')}) AS name, min(foodon_id) AS foodon_id, count(DISTINCT foodon_id) AS n_entries FROM (SELECT foodon_label AS name, foodon_id FROM foodon_terms UNION ALL SELECT unnest(alt_labels), foodon_id FROM foodon_terms) WHERE name IS NOT NULL GROUP BY 1",
    "feature_tokens": _W + """, f AS (SELECT 'concept:' || unnest(concepts) AS feature FROM works UNION ALL SELECT 'author:' || unnest(authors) FROM works UNION ALL SELECT 'type:' || type FROM works UNION ALL SELECT 'language:' || language FROM works)
        SELECT feature, count(*) AS n_works FROM f WHERE feature IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
    "lineage_works": _W + " SELECT work, language FROM works WHERE language = 'es' OR language IN ('en', 'fr') AND regexp_matches(coalesce(lower(title), ''), 'compost|glass|waste') AND NOT regexp_matches(coalesce(lower(title), ''), 'review')",
    "vector_counts": _W + """ SELECT cluster, count(*) AS n_expected, count(v.work) AS n_found, count(*) = count(v.work) AS complete FROM works LEFT JOIN (SELECT DISTINCT node_id AS work FROM abstract_vectors WHERE len(vector) = 384) v USING (work) WHERE trim(abstract) <> '' GROUP BY 1""",
    "venue_words": """WITH r AS (SELECT record_id, list_distinct(list_filter(regexp_split_to_array(lower(max(source_title)), '[ |]'), lambda x: x <> '')) AS p FROM scopus_records GROUP BY 1)
        SELECT record_id, unnest(CASE WHEN p IS NULL OR len(p) = 0 THEN [NULL] ELSE p END) AS part FROM r""",
    "cleaned_abstracts": _W + f", t AS (SELECT work, {_nested('lower(abstract)')} AS t FROM works WHERE abstract IS NOT NULL) SELECT work, length(t)::INT AS n, md5(t) AS digest FROM t",
    "tri_state_flags": """SELECT CASE WHEN lower(trim(ner_noise_flag::VARCHAR)) IN ('true', '1', 'yes', 'y') THEN 'true' WHEN lower(trim(ner_noise_flag::VARCHAR)) IN ('false', '0', 'no', 'n') THEN 'false' ELSE 'unknown' END AS state, count(*) AS n, count(DISTINCT node_id) AS n_nodes FROM ingredients GROUP BY 1""",
}
