"""Curation of records, null models and resampling on small cases."""

import itertools
import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.operators import curation as K
from quire.operators import resampling as S
from quire.sources.writers import newick


def test_proposals_and_hubs(spark):
    pairs = spark.createDataFrame([("broth wine", "wine broth", 0.5), ("fig", "figs", 0.95), ("old fig", "fig", 0.97), ("a", "z", 0.1)], "a string, b string, similarity double")
    pool = spark.createDataFrame([(e, n) for e, n in (("broth wine", 2), ("wine broth", 5), ("fig", 9), ("figs", 9), ("old fig", 1), ("a", 1), ("z", 1))], "entity string, n long")
    got = {(r.root, r.merged): r.action for r in K.proposals(pairs, pool).collect()}
    assert got == {("wine broth", "broth wine"): "merge", ("fig", "figs"): "review", ("fig", "old fig"): "merge", ("a", "z"): "discard"}
    hubs = K.by_hub(K.proposals(pairs, pool))
    assert {(r.root, r.merged, r.similarity) for r in K.listed(hubs).collect()} == {("wine broth", "broth wine", 0.5), ("fig", "figs", 0.95), ("fig", "old fig", 0.97), ("a", "z", 0.1)}


def test_reconciled(spark):
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c")], "root string, merged string")
    answers = spark.createDataFrame([("a", "b", 1, "keep"), ("a", "b", 2, " merge "), ("x", "y", 1, "merge")], "root string, merged string, at int, decision string")
    assert {(r.merged, r.decision) for r in K.reconciled(asked, answers).collect()} == {("b", "MERGE"), ("c", "UNKNOWN")}


def test_nested_items_and_pairs(spark):
    rows = [(1, [("Fig", 0.5, ["fig"]), ("fig ", 0.9, ["figs", None]), (None, 1.0, ["x"])]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "k int, items array<struct<name:string,confidence:double,forms:array<string>>>")
    got = {r.k: [(i.name, i.confidence, [f for f in i.forms if f]) for i in r["items"]] for r in K.merged_items(df, "k", "items", "name", "confidence", "forms").collect()}
    assert got == {1: [("fig", 0.9, ["fig", "figs"])], 2: [], 3: []}
    p = spark.createDataFrame([("a; b;c", "1;2"), (None, "1")], "x string, y string").select(K.paired_lists(F.col("x"), F.col("y")).alias("p")).collect()
    assert [[tuple(q) for q in r.p] for r in p] == [[("a", "1"), ("b", "2")], []]


def test_contained_and_flagged(spark):
    l = spark.createDataFrame([("red fig jam",), ("figure",), ("fig",)], "a string")
    r = spark.createDataFrame([("fig jam",), ("a red fig jam pot",)], "b string")
    assert {(x.a, x.b) for x in K.containment_pairs(l, r, "a", "b").collect()} == {("red fig jam", "fig jam"), ("red fig jam", "a red fig jam pot")}
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", None)], "id string, bad boolean")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    n, e = K.flagged_without(nodes, edges, F.col("bad"))
    assert {x.id for x in n.collect()} == {"a", "c"} and [(x.src, x.dst) for x in e.collect()] == [("a", "c")]


def test_classified(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a"), (3, "b"), (3, "x"), (3, "y")], "r int, i string")
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (2, "y")], "region int, marker string")
    assert {(x.record, x.region, x.hits) for x in K.classified(items, "r", "i", s, 2).collect()} == {(1, 1, 2), (3, 2, 2)}


def test_shuffled_labels_keep_counts(spark):
    labels = spark.createDataFrame([(f"n{i}", i % 3) for i in range(30)] + [("u", None)], "id string, l int")
    x = S.shuffled_labels(labels, "id", "l", 4).groupBy("draw", "label").count().collect()
    assert len(x) == 12 and {r["count"] for r in x} == {10}


def test_betweenness_of_a_path_and_star(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    assert {r.id: r.betweenness for r in S.betweenness(path).collect()} == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}
    star = spark.createDataFrame([("o", x) for x in "pqrs"], "a string, b string")
    assert {r.id: r.betweenness for r in S.betweenness(star).collect()}["o"] == 6.0


def test_null_modularity_is_lower(spark):
    e = spark.createDataFrame([(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(8) for j in range(i + 1, 8)], "a string, b string")
    labels = spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in range(8)], "id string, label string")
    assert all(r.q < 0.4 for r in S.null_modularity(e, labels, 3).collect())


def test_null_modularity_leaves_out_nodes_without_label(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "d"), ("a", "x"), ("d", "c"), ("c", "b")], "a string, b string")
    labels = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", None), ("x", None)], "id string, label int")
    # a-b and b-c are left, which no swap changes
    assert [(r.draw, round(r.q, 9)) for r in S.null_modularity(e, labels, 2).orderBy("draw").collect()] == [(0, -0.125), (1, -0.125)]
    assert S.null_modularity(e.limit(0), labels, 2).collect() == []


def test_swaps_keep_degrees_and_reach_all_graphs_alike_in_little_memory():
    low = (1 << 32) - 1
    sides = lambda e: list(zip((e >> 32).tolist(), (e & low).tolist()))
    path = [(0, 1), (1, 2), (2, 3), (3, 4)]
    seen = Counter(frozenset(sides(S.swapped(np.array([a << 32 | b for a, b in path]), 40, np.random.default_rng(k)))) for k in range(600))
    fit = [set(g) for g in itertools.combinations(itertools.combinations(range(5), 2), 4) if [sum(i in x for x in g) for i in range(5)] == [1, 2, 2, 2, 1]]
    assert set(seen) == {frozenset(g) for g in fit} and max(seen.values()) < 1.6 * min(seen.values())
    rng = np.random.default_rng(3)
    a, b = (rng.random((2, 600_000)) ** 2 * 50_000).astype(np.int64)
    edges = np.unique((np.minimum(a, b) << 32 | np.maximum(a, b))[a != b])
    degree = lambda e: np.bincount(e >> 32, minlength=50_000) + np.bincount(e & low, minlength=50_000)
    before, was = degree(edges), edges.copy()
    tracemalloc.start()
    S.swapped(edges, 3, rng)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (degree(edges) == before).all() and len(np.unique(edges)) == len(edges) and ((edges >> 32) < (edges & low)).all()
    assert np.isin(edges, was).mean() < 0.2 and peak < 12 * len(edges) + 40 * S.STEP + 10_000_000


def test_edges_of_a_draw_are_gathered_and_swapped_in_little_memory(monkeypatch):
    monkeypatch.setattr(S, "STEP", 1 << 15)
    rng = np.random.default_rng(5)
    a, b = (rng.random((2, 2_000_000)) ** 2 * 500_000).astype(np.int64)
    keys = (np.minimum(a, b) << 32 | np.maximum(a, b))[a != b]
    peak = []
    tracemalloc.start()
    for step in (lambda: S._gathered(keys[lo : lo + 10_000].copy() for lo in range(0, len(keys), 10_000)), lambda: S.swapped(edges, 1, rng)):
        base = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        edges = step()
        peak.append(tracemalloc.get_traced_memory()[1] - base)
    tracemalloc.stop()
    assert max(peak) < 11 * len(keys) + 80 * S.STEP
    assert (S._gathered(iter([keys[:5], keys[:3], keys[5:]])) == np.unique(keys)).all() and len(S._gathered(iter([]))) == 0


def test_null_modularity_makes_each_draw_in_a_task_of_its_own_from_small_values(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{(i * k) % 997}") for i in range(997) for k in (2, 3, 5)], "a string, b string")
    labels = spark.createDataFrame([(f"n{i}", i % 4) for i in range(997)], "id string, label int")
    got = S.null_modularity(e, labels, 6).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.draw for r in got) == list(range(6)) and len({r.task for r in got}) == 6 and len({r.q for r in got}) > 1
    assert S.PACKED * 8 * 10_000 < 16_000_000


def test_null_modularity_makes_the_draws_of_the_reference_and_equal_ones_in_any_task(spark, monkeypatch):
    from quire.plans import curation_queries as Q

    refs = [(f"n{i}", [f"n{(i * k) % 97}" for k in (2, 3, 5)], i % 4) for i in range(97)]
    monkeypatch.setattr(Q, "works", lambda *_: spark.createDataFrame(refs, "work string, refs array<string>, cluster int"))
    got = {r.draw: r.q for r in Q.null_modularity(spark, "").collect()}
    assert sorted(got) == list(range(1000)) and len(set(got.values())) > 20
    e = spark.createDataFrame([(o, d) for o, r, _ in refs for d in r], "a string, b string")
    labels = spark.createDataFrame([(o, k) for o, _, k in refs], "id string, label int")
    assert {r.draw: r.q for r in S.null_modularity(e, labels, 5).collect()} == {k: got[k] for k in range(5)}


def test_modularity_z_makes_the_draws_of_the_reference(spark, monkeypatch):
    from quire.plans import exchange_queries as Q

    refs = [(f"n{i}", [f"n{j}" for j in range(i // 8 * 8, i // 8 * 8 + 8) if j != i], i // 8) for i in range(64)]
    monkeypatch.setattr(Q, "works", lambda *_: spark.createDataFrame(refs, "work string, refs array<string>, cluster int"))
    got = Q.modularity_z(spark, "").first()
    assert got.n_draws == 1000 and abs(got.observed - 0.875) < 1e-9 and got.z > 20 and abs(got.p - 1 / 1001) < 1e-9 and got.low < got.mean < got.high


def test_swaps_go_on_until_as_many_are_made():
    star = np.array([0 << 32 | k for k in range(1, 30)] + [1 << 32 | k for k in range(2, 30)])  # most proposals fail
    made = []

    class Counted(np.random.Generator):
        def shuffle(self, x):
            made.append(len(x))
            super().shuffle(x)

    S.swapped(star.copy(), 20, Counted(np.random.PCG64(1)))
    S.swapped(star.copy(), 20, Counted(np.random.PCG64(1)), 10 * len(star))
    assert 2 * 20 < len(made) <= 20 + 10 * 20


def test_samples_and_random_rankings(spark):
    df = spark.createDataFrame([(i, "x" if i < 50 else "y" if i < 51 else None) for i in range(61)], "id int, s string")
    n = {r.s: r["count"] for r in S.stratified(df, "id", "s", 0.2).groupBy("s").count().collect()}
    assert n == {"x": 10, "y": 1, None: 2}
    ids = spark.range(100).select(F.col("id"))
    r = S.random_ranking(ids, ids, 5).groupBy("query").count().collect()
    assert len(r) == 100 and {x["count"] for x in r} == {5}


def test_co_association(spark):
    rows = [(0, "a", 1), (0, "b", 1), (0, "c", 2), (1, "a", 1), (1, "b", 2), (2, "c", 1)]
    got = {(r.a, r.b): r.share for r in S.co_association(spark.createDataFrame(rows, "run int, item string, cluster int")).collect()}
    assert got == {("a", "b"): 0.5}


def test_neighbour_joining_recovers_an_additive_tree():
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    text = newick(S.neighbour_joining(list("abcde"), d))
    assert "(a:2,b:3)" in text and "(e:1,d:2)" in text or "(d:2,e:1)" in text
    assert newick(S.neighbour_joining(["x"], np.zeros((1, 1)))) == "x;"
