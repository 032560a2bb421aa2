"""Ranks, places, null models, scatter and selection against plain computations on small data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import resampling as S
from quire.operators import vectors as V


def edges(seed=1, n=40, m=120):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)})


def test_pagerank_equals_the_linear_solution(spark):
    e = edges()
    names = sorted({x for p in e for x in p})
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in e:
        m[at[b], at[a]] += 1
    out = m.sum(0)
    m[:, out > 0] /= out[out > 0]
    m[:, out == 0] = 1 / len(names)
    want = np.linalg.solve(np.eye(len(names)) - 0.85 * m, np.full(len(names), 0.15 / len(names)))
    got = {r.id: r["rank"] for r in G.pagerank(spark.createDataFrame(e, "src string, dst string")).collect()}
    assert set(got) == set(names) and all(abs(got[x] - want[at[x]]) < 1e-5 for x in names)
    assert G.pagerank(spark.createDataFrame([], "src string, dst string")).collect() == []
    with pytest.raises(RuntimeError):
        G.pagerank(spark.createDataFrame(e, "src string, dst string"), tolerance=1e-15, most_steps=5)


def test_eigenvector_centrality(spark):
    e = [(a, b, 1 + (k % 3)) for k, (a, b) in enumerate(edges(2, 15, 60)) if a < b]
    names = sorted({x for p in e for x in p[:2]})
    at = {x: i for i, x in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b, n in e:
        m[at[a], at[b]] = m[at[b], at[a]] = n
    want = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.id: r.centrality for r in G.eigenvector_centrality(spark.createDataFrame(e, "a string, b string, n int"), tolerance=1e-8, most_steps=400).collect()}
    assert all(abs(got[x] - want[at[x]]) < 1e-4 for x in names)
    assert G.eigenvector_centrality(spark.createDataFrame([], "a string, b string, n int")).collect() == []


def test_components_that_need_more_steps_raise(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(200)], "src string, dst string")
    assert {r.component for r in G.connected_components(chain).collect()} == {"n000"}
    with pytest.raises(RuntimeError):
        G.connected_components(chain, most_steps=1)


def test_places_over_many_parts(spark):
    keys = [f"k{i:04}" for i in random.Random(3).sample(range(5000), 700)]
    df = spark.createDataFrame([(k, "q") for k in keys], "key string, i string").repartition(40)
    got = {r.key: (r.i, r.n) for r in S.numbered(df, "key").collect()}
    assert got == {k: (i, 700) for i, k in enumerate(sorted(keys))}


def test_rotated_null(spark):
    rng = random.Random(4)
    labels = [(f"n{i:02}", rng.choice("ab")) for i in range(40)]
    e = [x for x in edges(5) if x[0] != x[1]]
    name = [k for k, _ in labels]
    lab = [v for _, v in labels]
    shares = []
    for d in range(10):
        moved = {k: lab[(i + d * (40 // 10)) % 40] for i, k in enumerate(name)}
        shares.append(np.mean([moved[a] != moved[b] for a, b in e]))
    null = np.array(shares[1:])
    r = S.rotated_cross_share(spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame([*labels, ("x", None)], "id string, g string"), "id", "g", 9).first()
    assert r.n_draws == 9 and abs(r.observed - shares[0]) < 1e-9 and abs(r.mean - null.mean()) < 1e-9 and abs(r.sd - null.std(ddof=1)) < 1e-9
    assert abs(r.z - (shares[0] - null.mean()) / null.std(ddof=1)) < 1e-6 and abs(r.p_low - (1 + (null <= shares[0] + 1e-12).sum()) / 10) < 1e-9


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    centres = np.eye(8)[:3] * 3
    x = np.concatenate([c + 0.2 * rng.normal(size=(40, 8)) for c in centres])
    return x, spark.createDataFrame([(i, i // 40, [float(v) for v in r]) for i, r in enumerate(x)], "key int, label int, v array<double>")


def test_scatter(blobs):
    x, df = blobs
    g = np.arange(120) // 40
    c = np.array([x[g == k].mean(0) for k in range(3)])
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    s = np.array([d[g == k, k].mean() for k in range(3)])
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    own = d[np.arange(120), g]
    other = np.where(np.arange(3)[None] == g[:, None], np.inf, d).min(1)
    ch = (sum(40 * ((c[k] - x.mean(0)) ** 2).sum() for k in range(3)) / 2) / ((own**2).sum() / 117)
    r = V.label_scatter(df, "label", "v").first()
    assert abs(r.davies_bouldin - db) < 1e-9 and abs(r.calinski_harabasz - ch) < 1e-6 and r.least == 40
    assert abs(r.silhouette - np.mean((other - own) / np.maximum(other, own))) < 1e-9


def test_the_right_number_of_groups_is_chosen(blobs):
    rows = V.k_selection(blobs[1], "key", "v", [2, 3, 6]).collect()
    assert {r.k for r in rows if r.chosen} == {3}


@pytest.mark.parametrize("block", [4096, 25])
def test_pairs_above(spark, blobs, block):
    x, _ = blobs
    rows = [(i, [float(v) for v in r], "q") for i, r in enumerate(x[:70])] + [(900, [0.0] * 8, "q"), (901, None, "q"), (None, [1.0] * 8, "q")]
    u = x[:70] / np.linalg.norm(x[:70], axis=1, keepdims=True)
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if u[i] @ u[j] >= 0.97}
    got = V.pairs_above(spark.createDataFrame(rows, "id int, e array<double>, p string"), "id", "e", 0.97, block).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 50


def test_h_index_by_counts(spark, monkeypatch):
    from quire.plans import graph_queries as Q

    rng = random.Random(7)
    rows = [(f"W{i:03}", 2000, rng.choice([None, 0, 1, 2, 3, 5, 8, 40]), 1, rng.sample(["A", "B", "C", "D"], rng.randint(1, 3))) for i in range(90)]
    monkeypatch.setattr(Q, "works", lambda *_: spark.createDataFrame(rows, "work string, year int, citations int, cluster int, authors array<string>"))
    for r in Q.h_index(spark, "").collect():
        c = sorted((x[2] or 0 for x in rows if r.author in x[4]), reverse=True)
        assert r.h == sum(v >= k + 1 for k, v in enumerate(c)) and r.n == len(c)


def test_whole_words_of_a_query_stay_once(spark, monkeypatch):
    from quire.plans import upkeep_queries as U

    monkeypatch.setattr(U, "table", lambda *_: spark.createDataFrame([(1, "Glass and glass and  GLASS"), (2, "none"), (3, None)], "doc_id long, text string"))
    got = {r.doc_id: r.n_topic for r in U.down_weighted(spark, "").collect()}
    assert got == {1: 2, 2: 0}
    assert U.down_weighted(spark, "").where(F.col("doc_id") == 1).first().digest == spark.sql("select md5('glass and topic and topic') d").first().d


def modularity(e, of):
    m = sum(e.values())
    deg, inside = {}, 0.0
    for (a, b), w in e.items():
        deg[of[a]] = deg.get(of[a], 0) + w
        deg[of[b]] = deg.get(of[b], 0) + w
        inside += w * (of[a] == of[b])
    return inside / m - sum((d / (2 * m)) ** 2 for d in deg.values())


def test_louvain(spark):
    cliques = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    e = {(x, y): 2 for c in cliques for i, x in enumerate(c) for y in c[i + 1 :]} | {("a0", "b0"): 1, ("b1", "c1"): 1}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in e.items()], "a string, b string, n int")
    assert {r.id: r.community for r in G.louvain(df).collect()} == {x: c[0] for c in cliques for x in c}
    rng = random.Random(8)
    r = {(f"n{a:02}", f"n{b:02}"): rng.randint(1, 3) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.4 if a // 10 == b // 10 else 0.03)}
    got = {x.id: x.community for x in G.louvain(spark.createDataFrame([(a, b, w) for (a, b), w in r.items()], "a string, b string, n int")).collect()}
    assert modularity(r, got) >= modularity(r, {x: int(x[1:]) // 10 for x in got}) - 0.02
    assert G.louvain(df.limit(0)).collect() == []
