"""Queries whose inputs have elements that nearly every work holds: none may be left out."""

import itertools

from quire.operators import graph as G


def test_similar_sets_equal_brute_force_with_frequent_elements(spark):
    sets = {f"W{i:04}": {"all", f"r{i % 7}", f"q{i % 11}"} if i % 3 else {"all", "most"} for i in range(240)}
    m = spark.createDataFrame([(o, e) for o, s in sets.items() for e in s], "work string, c string")
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {k: v for k, v in want.items() if v >= 0.3}
    for least in (0.3, 0.5, 1.0):
        got = G.similar_sets(m, "work", "c", least).collect()
        assert len(got) == len({(r.a, r.b) for r in got})
        assert {(r.a, r.b): r.jaccard for r in got} == {k: v for k, v in want.items() if v >= least}


def test_similar_topics_take_all_concepts(spark, monkeypatch):
    from quire.plans import graph_queries as Q

    rows = [(f"W{i:04}", ["everywhere"]) for i in range(130)] + [("X1", ["everywhere", "b", "c", "d"])]
    monkeypatch.setattr(Q, "works", lambda *_: spark.createDataFrame(rows, "work string, concepts array<string>"))
    got = Q.similar_topics(spark, "").collect()
    assert len(got) == 130 * 129 // 2 and {r.jaccard for r in got} == {1.0}


def test_rare_bridges_drop_only_the_fifty_most_frequent(spark, monkeypatch):
    from quire.plans import graph_queries as Q

    concepts = {f"W{i:04}": [*(f"top{k:02}" for k in range(50)), *(["rare", "other"] if i < 40 else [])] for i in range(45)}
    concepts |= {"X1": ["rare", "alone"], "X2": ["other", "rare", "alone"]}
    rows = [(o, i % 2, c) for i, (o, c) in enumerate(concepts.items())]
    monkeypatch.setattr(Q, "works", lambda *_: spark.createDataFrame(rows, "work string, cluster int, concepts array<string>"))
    left = {o: (k, {x for x in c if not x.startswith("top")}) for o, k, c in rows}
    want = {(a, b, len(left[a][1] & left[b][1]), left[a][0], left[b][0]) for a, b in itertools.combinations(sorted(left), 2)}
    want = {x for x in want if x[2] >= 2 and x[3] != x[4]}
    got = Q.rare_bridges(spark, "").select("a", "b", "n", "cluster_a", "cluster_b").collect()
    assert len(want) > 400 and len(got) == len(want) and set(map(tuple, got)) == want


def test_rankings_count_terms_that_most_documents_have(spark):
    from quire.operators import retrieval as R

    terms = {f"W{i:03}": {"all", f"a{i % 3}", f"b{i % 5}", f"c{i % 31}"} for i in range(150)} | {"W999": {"all"}, "W998": set()}
    t = spark.createDataFrame([(o, sorted(s)) for o, s in terms.items()], "id string, terms array<string>")
    asked = [o for o in terms if o.endswith("0")] + ["W999"]
    q = t.where(t.id.isin(asked))
    want = {}
    for o in asked:
        scored = sorted((-len(terms[o] & terms[d]), d) for d in terms if d != o and terms[o] & terms[d])[:10]
        want |= {(o, d): (k + 1, float(-n)) for k, (n, d) in enumerate(scored)}
    sizes = {o: sum(bool(terms[o] & s) for s in terms.values()) for o in asked}
    for block in (40, 8000):
        assert {(r.query, r.doc): (r.place, r.score) for r in R.overlap_top(q, t, 10, block).collect()} == want
        assert {r.query: r.n_docs for r in R.overlap_sizes(q, t, block).collect()} == sizes


def test_ranking_and_search_take_all_words(spark, monkeypatch):
    from quire.plans import measure_queries as M

    rows = [(f"W{i * 20:05}", "common words", "common words", ["c"]) for i in range(80)]
    monkeypatch.setattr(M, "works", lambda *_: spark.createDataFrame(rows, "work string, title string, abstract string, concepts array<string>"))
    assert {r.n_docs for r in M.boolean_search(spark, "").collect()} == {80}
    assert M.lexical_ranking(spark, "").count() == M._topical(spark, "").count() == 800


def test_ranking_reads_abstracts_and_their_bigrams(spark, monkeypatch):
    from quire.plans import measure_queries as M

    texts = ["glass from the compost heap", "compost heap glass", "heap compost and glass", "starch", None]
    rows = [(f"W{i + 20:05}", "same title", x, ["c"]) for i, x in enumerate(texts)]
    monkeypatch.setattr(M, "works", lambda *_: spark.createDataFrame(rows, "work string, title string, abstract string, concepts array<string>"))
    got = [(r.query, r.doc, r.place, r.score) for r in M.lexical_ranking(spark, "").orderBy("place").collect()]
    assert got == [("W00020", "W00021", 1, 4), ("W00020", "W00022", 2, 3)]
