"""Spread, seeded clusters, walks and regression on small cases."""

import math

import numpy as np
from pyspark.sql import functions as F

from quire.operators import spectra as P


def test_diversity_equals_all_pairs(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    d = P.diversity(spark.createDataFrame([(r.tolist(),) for r in x] + [(None,), ([1.0],)], "v array<double>"), "v", 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    assert d["n"] == 40 and abs(d["mean_distance"] - (1 - s[np.triu_indices(40, 1)].mean())) < 1e-9
    e = np.linalg.eigvalsh(np.cov(u.T, bias=True))
    assert abs(d["participation_ratio"] - e.sum() ** 2 / (e**2).sum()) < 1e-6
    assert math.isnan(P.diversity(spark.createDataFrame([], "v array<double>"), "v", 5)["mean_distance"])


def test_seeded_clusters_keep_empty_ones(spark):
    df = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(3)] + [(9, [-1.0, 0.0])], "k int, v array<double>")
    seeds = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.0, -1.0])], "cluster int, centroid array<double>")
    assert {r.k: r.cluster for r in P.seeded_kmeans(df, "k", "v", seeds, 4).collect()} == {0: 0, 1: 0, 2: 0, 9: 1}


def test_walks_follow_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    rows = P.uniform_walks(edges, 4, 2).collect()
    assert len(rows) == 6 and all({x, y} in ({"a", "b"}, {"b", "c"}) for r in rows for x, y in zip(r.path, r.path[1:]))
    assert P.walk_vectors(P.uniform_walks(edges, 4, 2), 4).count() == 3


def test_logit_finds_a_slope(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("x"), (F.pmod(F.xxhash64("id"), F.lit(20)) < F.col("id") % 20).alias("y"), F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("c"))
    got = {r.term: r for r in P.logit(df, "y", ["x"], ["c"]).collect()}
    assert set(got) == {"x", "c=q", "(constant)"} and got["x"].low > 1
