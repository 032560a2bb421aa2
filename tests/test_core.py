"""Hand-checked cases of the core's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import text as X
from quire.operators import graph as G
from quire.operators import relational as R
from quire.operators import retrieval as Q
from quire.operators import stats as S
from quire.operators import vectors as V
from quire.operators import vocabulary as C
from quire.operators.orphans import orphan_references, orphans_by_period, work_references


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x").alias("y")).first().y


@pytest.mark.parametrize("given_,want", [("W2000000028", "W2000000028"), (" w2000000028", "W2000000028"), ("https://oax.example/works/W1/", "W1"), ("", None), ("  ", None), ("/", None), (None, None)])
def test_work_ids(spark, given_, want):
    assert one(spark, I.work_id, given_) == want


@pytest.mark.parametrize("given_,want", [("doi:10.0113/ABC", "10.0113/abc"), (" https://doi.example/10.0113/abc ", "10.0113/abc"), ("n/a", None), (None, None)])
def test_doi_keys(spark, given_, want):
    assert one(spark, I.doi_key, given_) == want


PAPERS = "openalex_id string, status string, ingested_at timestamp, referenced_works array<string>, first_seen string, since string"


def test_orphans(spark):
    t = "2021-0{}-01".format
    papers = [
        ("W1", "active", t(1), ["W2", "w2", None, "", "W3", "W9", "W1"], "q", "q"), (" w1", None, t(3), ["W4"], "q", "q"), ("W2", "active", t(1), None, "q", "q"), ("W2", " Deleted ", t(2), [], "q", "q"),
        ("W3", "deleted", t(1), ["W1"], "q", "q"), ("W3", "active", t(2), None, "q", "q"), ("W4", None, t(2), None, "q", "q"), (None, "active", t(1), ["W7"], "q", "q"),
    ]
    authors = [("a1", "W4", t(1), "q"), ("a1", "w4", t(5), "q"), ("a2", "W4", t(4), "q"), (None, "W9", t(1), "q"), ("a3", None, t(1), "q"), ("a4", "W8", None, "q")]
    stamp = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    p = stamp(spark.createDataFrame(papers, PAPERS.replace("timestamp", "string")), "ingested_at")
    a = stamp(spark.createDataFrame(authors, "author_id string, paper_id string, ingested_at string, first_seen string"), "ingested_at")
    found = orphan_references(*work_references(p, a))
    assert {(r.table_name, r.record_id, r.ref_id, r.cause) for r in found.collect()} == {
        ("papers", "W1", "W2", "deleted"), ("papers", "W1", "W9", "missing"), ("papers", "W1", "W4", "late"), ("authorships", "A1", "W4", "late"), ("authorships", "A4", "W8", "missing")}
    report = {(r.table_name, str(r.period), r.cause): r.n_references for r in orphans_by_period(found).collect()}
    assert report[("papers", "2021-01-01", "late")] == 1 and report[("authorships", "None", "missing")] == 1
    assert orphan_references(*work_references(p.limit(0), a.limit(0))).collect() == []


def tops(spark, **lists):
    return spark.createDataFrame([(c, t, i) for c, ts in lists.items() for i, t in enumerate(ts, 1)] or [("x", "y", 1)], "cluster string, term string, place int")


@pytest.mark.parametrize("x,y,want", [("abc", "abc", 1 - 0.9**3), ("ab", "ba", 0.09), ("ab", "cd", 0.0)])
def test_rank_biased_overlap(spark, x, y, want):
    assert abs(C.rank_biased_overlap(tops(spark, a=list(x), b=list(y)), 0.9).first().rbo - want) < 1e-12


def test_js_distance(spark):
    n = lambda **k: spark.createDataFrame([(c, t, v) for c, d in k.items() for t, v in d.items()], "cluster string, term string, n long")
    assert abs(C.js_distances(n(a={"x": 2}, b={"y": 5})).first().distance - 1) < 1e-12
    assert abs(C.js_distances(n(a={"x": 2, "y": 2}, b={"x": 5, "y": 5})).first().distance) < 1e-7


def edges(spark, pairs, labels=None):
    e = spark.createDataFrame(pairs, "src string, dst string")
    return e if labels is None else G.labelled(e, spark.createDataFrame(list(labels.items()), "id string, l string"), "id", "l")


def test_modularity_participation_insularity(spark):
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")]
    lab = dict.fromkeys("abc", "A") | dict.fromkeys("xyz", "B")
    assert abs(G.modularity(edges(spark, two, lab), 1).first().q - 0.5) < 1e-12 and G.modularity(edges(spark, two, lab)).first().q is None
    four = edges(spark, [("s", "a"), ("s", "b"), ("s", "x"), ("s", "y")], lab | {"s": "A"})
    assert abs(G.participation(four).first().participation - 0.5) < 1e-12
    three = G.insularity(edges(spark, [("a", "b"), ("a", "x"), ("b", "y")], lab)).collect()
    assert [(r.label, r.n_out, r.n_internal) for r in three] == [("A", 3, 1)] and abs(three[0].percent_internal - 100 / 3) < 1e-9


def test_cross_shares_and_cohesion(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("c", "y")], dict.fromkeys("abc", "A") | dict.fromkeys("xy", "B"))
    assert C.cross_share(e).first().s_cross == 0.5
    d = spark.createDataFrame([("A", "B", 0.8)], "a string, b string, distance double")
    assert abs(C.cohesion_score(d, C.flow(e), C.cross_share(e)).first().csc - 0.6) < 1e-12
    i = C.incidence_share(edges(spark, [("a", "b"), ("a", "x")], dict.fromkeys("ab", "A") | {"x": "B"})).first()
    assert (i.total, i.intra) == (3, 1) and abs(i.s_cross - 2 / 3) < 1e-12
    s = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "cluster string, p double")
    assert abs(C.rao_stirling(s, d.withColumn("distance", F.lit(1.0))).first().rao_stirling - 0.5) < 1e-12


def test_ranks_mode_and_windows(spark):
    df = spark.createDataFrame([(5,), (3,), (3,), (1,)], "v int")
    assert sorted(r["rank"] for r in R.average_ranks(df, "v", descending=True).collect()) == [1, 2.5, 2.5, 4]
    m = R.mode_first(spark.createDataFrame([("g", "b"), ("g", "a"), ("g", None), ("g", None)], "g string, v string"), ["g"], "v").first()
    assert (m.mode, m.n) == ("a", 1)
    y = spark.createDataFrame([(1990,), (1995,), (1996,), (2010,), (None,)], "year int")
    assert {(r.start, r.end) for r in R.observed_windows(y, "year", 3).collect()} == {(1990, 1996), (1995, 2010)}


def test_latest_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r.k, r.v) for r in R.upsert(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_closure_and_redirect(spark):
    m = edges(spark, [("A", "B"), ("B", "C"), ("X", "Y"), ("Y", "X"), ("Z", "X")])
    roots = G.closure(m)
    assert {(r.id, r.root) for r in roots.collect()} == {("A", "C"), ("B", "C")}
    e = spark.createDataFrame([("A", "Q", 1), ("C", "Q", 2), ("A", "B", 5)], "src string, dst string, n long")
    assert {(r.src, r.dst, r.n) for r in G.redirect(e, roots, [], ["n"]).collect()} == {("C", "Q", 3)}


def test_components_and_ancestors(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("p", "q"), ("q", "r"), ("s", "s"), (None, "t")]
    got = {r.id: r.component for r in G.connected_components(edges(spark, chain)).collect()}
    assert {got[f"n{i:03}"] for i in range(41)} == {"n000"} and {got[x] for x in "pqr"} == {"p"} and got["s"] == "s" and "t" not in got
    up = {(r.id, r.ancestor): r.depth for r in G.ancestors(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")])).collect()}
    assert up == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 1, ("b", "a"): 2, ("c", "b"): 2}


def test_pagerank_sums_to_one(spark):
    r = {x.id: x["rank"] for x in G.pagerank(edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")])).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["b"] > r["a"]
    assert G.pagerank(edges(spark, [("a", "b")]).limit(0)).collect() == []


def test_fusion_recall_precision(spark):
    r = lambda rows: spark.createDataFrame(rows, "query string, doc string, place int")
    f = Q.fuse([r([("q", "x", 2), ("q", "y", 1)]), r([("q", "x", 2)])], 5).collect()
    assert f[0].doc == "x" and abs(f[0].score - 2 / 62) < 1e-12
    truth = spark.createDataFrame([("q", "x"), ("q", "z"), ("p", "x")], "query string, doc string")
    got = {x.query: x.recall_2 for x in Q.recall_at(r([("q", "x", 2), ("q", "y", 1)]), truth, [2]).collect()}
    assert got == {"q": 0.5, "p": 0.0} and Q.precision_at(r([("q", "x", 2), ("q", "y", 1)]), truth, 2).first().precision == 0.5


def test_statistics(spark):
    c = spark.createDataFrame([("a", "x", 10), ("a", "y", 20), ("b", "x", 20), ("b", "y", 10)], "r string, c string, n long")
    s = S.chi_square(c).first()
    assert abs(s.statistic - 6.6667) < 1e-4 and abs(s.cramers_v - 0.3333) < 1e-4 and S.chi_square(c, yates=True).first().statistic < s.statistic
    few = spark.createDataFrame([(float(i), 0.0) for i in range(1, 6)], "x double, y double")
    assert S.wilcoxon(few, "x", "y").first().z is None and S.wilcoxon(few, "x", "y", 3).first().w_plus == 15
    k = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "b"), (None, "a")], "a string, b string")
    assert abs(S.kappa(k, "a", "b").first().kappa - 0.4) < 1e-9
    e = S.empirical(1.0, [2.0, 3.0, 4.0])
    assert e["p_low"] == 0.25 and e["p_high"] == 1.0 and abs(S.normal_tail(1.96) - 0.05) < 1e-3
    b = S.bootstrap_mean(spark.range(1000).select(F.col("id").alias("v")), "v").first()
    assert b.low < 499.5 < b.high and b["mean"] == 499.5


def test_texts(spark):
    assert one(spark, X.slug, "Crème Brûlée!") == "creme_brulee" and one(spark, X.slug, None) == "unknown" and one(spark, X.slug, "中文").startswith("x_")
    assert one(spark, X.rebuilt, {"b": [1], "a": [0, 2]}, "map<string,array<int>>") == "a b a" and one(spark, X.rebuilt, {"a": [0]}, "map<string,array<int>>") == "a"
    assert one(spark, lambda c: X.protect_phrases(c, ["a b", "a b c"]), "x a b c y a b") == "x a_b_c y a_b"
    assert one(spark, X.first_year, "c. –450 or 1200") == -450 and one(spark, X.first_year, "none") is None
    assert one(spark, lambda c: X.count_terms(c, ["circular economy", "circular", "(?-i:CE)"]), "Circular  economy, circular\nCE ce") == 3 and one(spark, lambda c: X.count_terms(c, ["x"]), None) == 0
    assert one(spark, X.without_markup, "<p>A &amp; '''b''' [[x|c]] {{t|{{u}}}}</p>") == "A & b c"
    assert one(spark, lambda c: X.lenient_json(c, "a int"), 'Sure: ```{"a": 3}```').a == 3 and one(spark, X.safe_cell, "=1+1") == "'=1+1"
    assert one(spark, X.ingredient_name, "2 cups of Flour (sifted), well beaten") == "flour" and one(spark, X.singular, "berries") == "berry"
    assert one(spark, lambda c: X.terms(c, ["the"]), "The red fox") == ["red", "fox", "red fox"] and one(spark, X.truthy, " YES ") is True and one(spark, X.truthy, "?") is None
    assert [g.collect()[0].x for g in (spark.range(1).select(X.match_grade(F.lit(a), F.lit(b))[0].alias("x")) for a, b in (("Fig", "fig"), ("root fig", "fig root"), ("fig jam", "fig"), ("a", "b")))] == ["exact", "token_set", "partial", "none"]


def test_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.0, 0.0]), (4, "b", [-1.0, 0.0])], "id int, g string, v array<double>")
    assert [round(r.y, 6) if r.y is not None else None for r in df.select(V.cosine(F.col("v"), F.lit([1.0, 1.0]).cast("array<double>")).alias("y")).collect()] == [0.707107, 0.707107, None, -0.707107]
    assert {r.group: r.centroid for r in V.centroids(df, "g", "v").collect()} == {"a": [0.5, 0.5], "b": [-0.5, 0.0]}
    h = V.health(df, "v", 2).first()
    assert (h.zero, h.good) == (1, 3)
    near = {(r.a, r.b) for r in V.blocked_similarities(df, "id", "v", 1, blocks=3).collect() if r.a == 1}
    assert near in ({(1, 2)}, {(1, 3)})
    ari = V.rand_index(spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (2, "y")], "a int, b string"), "a", "b").first().ari
    assert ari == 1.0
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0]])
    assert V.average_linkage(d, 2).tolist() == [0, 0, 1, 1]
    assert [r.key for r in V.farthest_points(df, "id", "g", "v", 2).where("`group` = 'a'").orderBy("place").collect()] == [1, 2]


def test_trend_of_a_line(spark):
    rows = [("g", 2000 + i, 3 + 2 * i) for i in range(8)]
    t = C.trends(spark.createDataFrame(rows, "group string, year int, n long")).first()
    assert abs(t.slope - 2) < 1e-9 and abs(t.r2 - 1) < 1e-9 and t.growth_model == "linear" and math.isclose(t.autocorr1, 0.625, abs_tol=0.05)
