"""Spread of vector sets, seeded clustering, walks and regression by sums that tasks combine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.vectors import cosine
from quire.session import cut


def second_moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum, sum of outer products) of unit vectors; each task gives one matrix of dims x dims,
    which are added by place, so the driver gets dims * dims numbers."""

    def sums(batches):
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, dims))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        flat = np.concatenate([[n], s, p.ravel()])
        yield pd.DataFrame({"i": np.arange(len(flat)), "x": flat})

    rows = df.where(F.size(vector) == dims).select(F.col(vector).alias("v")).mapInPandas(sums, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")
    flat = rows["x"].to_numpy() if len(rows) else np.zeros(1 + dims + dims * dims)
    return int(flat[0]), flat[1 : dims + 1], flat[dims + 1 :].reshape(dims, dims)


def diversity(df: DataFrame, vector: str, dims: int) -> dict[str, float]:
    """mean_distance (cosine, over all pairs, from the sums alone), participation_ratio and
    spectral_entropy of the covariance; NaN with fewer than two rows."""
    n, s, p = second_moments(df, vector, dims)
    if n < 2:
        return {"n": n, "mean_distance": float("nan"), "participation_ratio": float("nan"), "spectral_entropy": float("nan")}
    e = np.clip(np.linalg.eigvalsh(p / n - np.outer(s / n, s / n)), 0, None)
    q = e / e.sum() if e.sum() > 0 else np.zeros(1)
    return {
        "n": n,
        "mean_distance": 1 - float((s @ s - n) / (n * (n - 1))),
        "participation_ratio": float(e.sum() ** 2 / (e**2).sum()) if (e**2).sum() > 0 else 0.0,
        "spectral_entropy": float(-(q[q > 0] * np.log(q[q > 0])).sum()),
    }


def seeded_kmeans(df: DataFrame, key: str, vector: str, seeds: DataFrame, steps: int = 8) -> DataFrame:
    """(key, cluster) by Lloyd's steps from given (cluster, centroid): rows go to the centroid of the
    highest cosine, the smaller cluster of equal ones; a cluster that empties keeps its centroid."""
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    now = cut(seeds.select("cluster", "centroid"))
    for step in range(steps):
        sims = rows.join(now).select("key", "v", "cluster", F.round(cosine(F.col("v"), F.col("centroid")), 9).alias("s"))  # centroids are few
        own = cut(sims.groupBy("key").agg(F.min(F.struct(-F.col("s"), F.col("cluster")))["cluster"].alias("cluster")))
        if step == steps - 1:
            break
        x = rows.join(own, "key").select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
        moved = x.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("moved"))
        now = cut(now.join(moved, "cluster", "left").select("cluster", F.coalesce("moved", F.transform("centroid", lambda c: c.cast("double"))).alias("centroid")))
    return own.withColumnRenamed("key", key)


def uniform_walks(edges: DataFrame, length: int, per_node: int, seed: int = 7) -> DataFrame:
    """(start, walk, path): ``per_node`` walks of ``length`` nodes from every node of an undirected
    graph (a, b), each step to the neighbour of the lowest hash of walk, step and neighbour."""
    near = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct())
    number = F.explode(F.sequence(F.lit(0), F.lit(per_node - 1)))
    now = near.select(F.col("x").alias("start")).distinct().select("start", number.alias("walk")).withColumn("path", F.array("start"))
    for step in range(length - 1):
        h = F.xxhash64("start", "walk", F.lit(step), F.lit(seed), "y")
        hop = now.withColumn("x", F.element_at("path", -1)).join(near, "x")
        now = cut(hop.groupBy("start", "walk", "path").agg(F.min(F.struct(h.alias("h"), "y"))["y"].alias("y")).select("start", "walk", F.concat("path", F.array("y")).alias("path")))
    return now


def walk_vectors(walks: DataFrame, dims: int = 32, seed: int = 7) -> DataFrame:
    """(id, vector) of the nodes by MLlib's skip-gram on walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = walks.select(F.transform("path", lambda x: x.cast("string")).alias("path"))
    model = Word2Vec(vectorSize=dims, minCount=1, inputCol="path", outputCol="v", seed=seed, maxIter=1).fit(words)
    return model.getVectors().select(F.col("word").alias("id"), vector_to_array("vector").alias("vector"))


def logit(df: DataFrame, outcome: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """(term, coefficient, error, odds_ratio, low, high) of a logistic regression with categories as
    fixed effects, the first of each left out; 95 per cent bounds."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    x = df.select(F.col(outcome).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in categories)).dropna()
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}_i", stringOrderType="alphabetDesc") for c in categories]
    stages += [OneHotEncoder(inputCols=[f"{c}_i" for c in categories], outputCols=[f"{c}_v" for c in categories])] if categories else []
    stages += [VectorAssembler(inputCols=[*numbers, *(f"{c}_v" for c in categories)], outputCol="features")]
    ready = Pipeline(stages=stages).fit(x)
    m = GeneralizedLinearRegression(family="binomial", labelCol="y").fit(ready.transform(x))
    labels = [s.labels for s in ready.stages[: len(categories)]]
    names = [*numbers, *(f"{c}={v}" for c, vs in zip(categories, labels) for v in vs[:-1]), "(constant)"]
    coefficients, errors = [*map(float, m.coefficients), float(m.intercept)], [float(e) for e in m.summary.coefficientStandardErrors]
    rows = [(n, c, e, *(float(np.exp(np.clip(v, -700, 700))) for v in (c, c - 1.96 * e, c + 1.96 * e))) for n, c, e in zip(names, coefficients, errors)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, error double, odds_ratio double, low double, high double")
