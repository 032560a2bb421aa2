"""Operators on vectors held as arrays, keyed by id."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.relational import top_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or missing."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Of length one; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def health(df: DataFrame, vector: str, dims: int, low: float = 1e-6, high: float = 1e6) -> DataFrame:
    """One row of counts: null, wrong size, with NaN or infinity, zero, of a length out of range, good."""
    v = F.col(vector)
    sized = F.size(v) == dims
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    n = norm(v)
    state = F.when(v.isNull(), "null").when(~sized, "wrong_size").when(odd, "not_finite").when(n == 0, "zero").when(~n.between(low, high), "out_of_range").otherwise("good")
    return df.select(state.alias("state")).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("null", "wrong_size", "not_finite", "zero", "out_of_range", "good")))


def centroids(df: DataFrame, group: str, vector: str, least: int = 1) -> DataFrame:
    """(group, n, centroid): mean vectors of groups of at least ``least``; sums combine before the
    shuffle, one row per group and place."""
    x = df.select(F.col(group).alias("group"), F.posexplode(vector).alias("i", "x")).groupBy("group", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    c = x.groupBy("group").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))
    return c.where(F.col("n") >= least)


def centroid_similarities(c: DataFrame) -> DataFrame:
    """(a, b, cosine) of every two groups' centroids."""
    x, y = c.select(F.col("group").alias("a"), F.col("centroid").alias("va")), c.select(F.col("group").alias("b"), F.col("centroid").alias("vb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))  # groups are few


def to_centroids(df: DataFrame, key: str, group: str, vector: str, c: DataFrame) -> DataFrame:
    """(key, own, group, cosine): every row against every centroid; centroids are one per group."""
    return df.select(key, F.col(group).alias("own"), F.col(vector).alias("v")).join(c.select("group", "centroid")).select(key, "own", "group", cosine(F.col("v"), F.col("centroid")).alias("cosine"))


def representatives(df: DataFrame, key: str, group: str, vector: str, n: int, digits: int = 9) -> DataFrame:
    """(group, key, place) of the rows nearest their own centroid."""
    sims = to_centroids(df, key, group, vector, centroids(df, group, vector)).where("own = group")
    return top_per_group(sims, ["group"], [F.desc(F.round("cosine", digits)), F.asc(key)], n).select("group", key, "place")


def cross_domain(df: DataFrame, key: str, group: str, vector: str, least: float) -> DataFrame:
    """(key, n_groups, second): rows whose cosine to at least two centroids is ``least`` or more, with
    the second highest."""
    sims = to_centroids(df, key, group, vector, centroids(df, group, vector)).where(F.col("cosine") >= least)
    return sims.groupBy(key).agg(F.count(F.lit(1)).alias("n_groups"), F.get(F.sort_array(F.collect_list("cosine"), asc=False), F.lit(1)).alias("second")).where("n_groups >= 2")


def source_centred(df: DataFrame, key: str, source: str, vector: str, strength: float = 1.0, least: int = 5) -> DataFrame:
    """(key, v): unit vectors less ``strength`` times their source's centroid, of unit length again;
    rows of sources smaller than ``least``, and those that vanish, keep their vector."""
    u = df.select(key, F.col(source).alias("source"), unit(F.col(vector)).alias("u"))
    c = centroids(u, "source", "u", least).select(F.col("group").alias("source"), "centroid")
    moved = F.zip_with("u", "centroid", lambda x, m: x - strength * m)
    x = u.join(c, "source", "left").withColumn("m", F.when(F.col("centroid").isNotNull(), moved))
    return x.select(key, F.when(F.col("m").isNotNull() & (norm(F.col("m")) > 1e-12), unit(F.col("m"))).otherwise(F.col("u")).alias("v"))


def blocked_similarities(df: DataFrame, key: str, vector: str, k: int, blocks: int | None = None, query: Column | None = None) -> DataFrame:
    """(a, b, cosine, place): each query row's exact ``k`` nearest others, in blocks of rows against
    blocks of queries; each block is one matrix product and gives k rows a query. ``query`` says which
    rows ask (all of them by default)."""
    spark = df.sparkSession
    n = df.count()
    blocks = blocks or max(1, -(-n // 4096))
    kind = df.schema[key].dataType.simpleString()
    base = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("float")).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    ask = base if query is None else df.where(query & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("float")).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    other = spark.range(blocks).select(F.col("id").alias("other"))
    grid = lambda x, asks: x.join(F.broadcast(other)).select(  # noqa: E731  (a bounded number of blocks)
        F.lit(asks).alias("asks"), "key", "v", (F.col("own") * blocks + F.col("other") if asks else F.col("other") * blocks + F.col("own")).alias("cell"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        mat = lambda x: np.stack(x["v"].to_numpy()).astype(np.float64)
        a, b = mat(q), mat(r)
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
        qa, rb = q["key"].to_numpy(), r["key"].to_numpy()
        out = []
        for lo in range(0, len(a), 1024):
            s = np.round(a[lo : lo + 1024] @ b.T, 9)
            s[qa[lo : lo + 1024, None] == rb[None, :]] = -np.inf
            m = min(k, s.shape[1])
            edge = -np.partition(-s, m - 1, axis=1)[:, m - 1 : m]
            i, j = np.nonzero((s >= edge) & np.isfinite(s))
            out.append(pd.DataFrame({"a": qa[lo + i], "b": rb[j], "cosine": s[i, j]}))
        return pd.concat(out)

    got = grid(ask, True).union(grid(base, False)).groupBy("cell").applyInPandas(product, f"a {kind}, b {kind}, cosine double")
    return top_per_group(got, ["a"], [F.desc("cosine"), F.asc("b")], k)


def mutual_edges(knn: DataFrame) -> DataFrame:
    """(a, b, weight) of neighbours either way as one undirected edge, the greater weight, above 0."""
    return knn.where("cosine > 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("cosine").alias("weight"))


def silhouette_by_centroid(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(group, n, cohesion, silhouette): mean cosine to the own centroid, and the mean of
    (b - a) / max(a, b) with cosine distances to the own and the nearest other centroid."""
    sims = to_centroids(df, key, group, vector, centroids(df, group, vector)).withColumn("d", 1 - F.col("cosine"))
    x = sims.groupBy(key, "own").agg(F.max(F.when(F.col("own") == F.col("group"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("group"), F.col("d"))).alias("b"))
    s = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return x.groupBy(F.col("own").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.avg(1 - F.col("a")).alias("cohesion"), F.avg(s).alias("silhouette"))


def scatter(df: DataFrame, group: str, vector: str) -> DataFrame:
    """One row: between and within sums of squares, and the Calinski-Harabasz index."""
    x = df.select(F.col(group).alias("g"), F.posexplode(vector).alias("i", "x"))
    per = x.groupBy("g", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.count(F.lit(1)) * F.var_pop("x")).alias("w"))
    all_ = x.groupBy("i").agg(F.avg("x").alias("mm"))
    s = per.join(all_, "i").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mm"), 2)).alias("between"), F.sum("w").alias("within"), F.countDistinct("g").alias("k"), (F.sum("n") / F.countDistinct("i")).alias("n"))
    return s.select("between", "within", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def farthest_points(df: DataFrame, key: str, group: str, vector: str, k: int) -> DataFrame:
    """(group, key, place): from the smallest key on, the row farthest from those chosen. Each group
    is read as one array, so groups must fit a task; split larger ones first."""
    kind, gkind = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        chosen, near = [0], 1 - x @ x[0]
        while len(chosen) < min(k, len(x)):
            chosen.append(int(np.round(near, 9).argmax()))
            near = np.minimum(near, 1 - x @ x[chosen[-1]])
        return pd.DataFrame({"group": pdf["group"].iloc[0], "key": pdf["key"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return df.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(vector).alias("v")).groupBy("group").applyInPandas(choose, f"group {gkind}, key {kind}, place int")


def diverse_relevant(df: DataFrame, key: str, group: str, vector: str, k: int, balance: float = 0.7) -> DataFrame:
    """(group, key, place): greedily the row with the greatest balance * relevance - (1 - balance) *
    likeness to those chosen; relevance is the cosine to the group's centroid. As above for groups."""
    kind, gkind = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        rel = x @ (x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12))
        chosen, like = [], np.zeros(len(x))
        for _ in range(min(k, len(x))):
            score = np.round(balance * rel - (1 - balance) * like, 9)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
            like = np.maximum(like, x @ x[chosen[-1]]) if len(chosen) > 1 else x @ x[chosen[-1]]
        return pd.DataFrame({"group": pdf["group"].iloc[0], "key": pdf["key"].to_numpy()[chosen], "place": range(1, len(chosen) + 1)})

    return df.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(vector).alias("v")).groupBy("group").applyInPandas(choose, f"group {gkind}, key {kind}, place int")


def rand_index(df: DataFrame, one: str, two: str) -> DataFrame:
    """One row with the adjusted Rand index of two labellings, from their contingency counts."""
    n = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = n.agg(F.sum(pairs("n")).alias("cells"), F.sum("n").alias("all_"))
    side = lambda c, name: n.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs("m")).alias(name))
    x = cells.crossJoin(side("a", "rows_")).crossJoin(side("b", "cols"))  # one row each
    expected = F.col("rows_") * F.col("cols") / (F.col("all_") * (F.col("all_") - 1) / 2)
    return x.select(F.try_divide(F.col("cells") - expected, (F.col("rows_") + F.col("cols")) / 2 - expected).alias("ari"))


def kmeans_labels(df: DataFrame, key: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """(key, cluster) by MLlib's k-means under cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", maxIter=20).fit(x).transform(x).select(key, F.col("prediction").alias("cluster"))


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters by average linkage on a full distance matrix, ties to the first pair.
    For driver-sized matrices of centroids."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(len(d)), np.arange(len(d)), np.ones(len(d), bool)
    while alive.sum() > max(1, k):
        i, j = divmod(int(np.round(d, 12).argmin()), len(d))
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def pairs_above(df: DataFrame, key: str, vector: str, least: float, block: int = 4096) -> DataFrame:
    """(a, b, cosine) of every two vectors, a < b, of cosine ``least`` at least: exact. Blocks of rows meet in the
    upper triangle of blocks, each two once, one matrix product a task; the work grows with the square of the
    rows, the result with the pairs. Null, zero and unlike long vectors are left out with their rows' nulls."""
    spark = df.sparkSession
    base = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    blocks = max(1, -(-base.count() // block))
    kind = base.schema["key"].dataType.simpleString()
    x = base.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    x = x.select("key", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        size = pdf["v"].map(len).mode().iloc[0]
        pdf = pdf[pdf["v"].map(len) == size]
        m = np.stack(pdf["v"].to_numpy())
        length = np.linalg.norm(m, axis=1)
        good = length > 0
        keys, m, own = pdf["key"].to_numpy()[good], m[good] / length[good, None], pdf["own"].to_numpy()[good]
        left, right = np.nonzero(own == p)[0], np.nonzero(own == q)[0]
        out_a, out_b, out_s = [keys[:0]], [keys[:0]], [np.zeros(0)]
        for lo in range(0, len(left), 1024):
            rows = left[lo : lo + 1024]
            s = m[rows] @ m[right].T
            i, j = np.nonzero(s >= least)
            a, b = keys[rows[i]], keys[right[j]]
            use = a < b if p == q else a != b
            out_a.append(np.minimum(a, b)[use])
            out_b.append(np.maximum(a, b)[use])
            out_s.append(s[i, j][use])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "cosine": np.concatenate(out_s)})

    return x.groupBy("p", "q").applyInPandas(meet, f"a {kind}, b {kind}, cosine double")


def label_scatter(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One row of a labelling's measures: calinski_harabasz, davies_bouldin, silhouette (by distance to centres) and
    least, the smallest group's size. One row per group goes to all tasks, so it is for few groups."""
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    e = df.where(F.col(label).isNotNull()).select(F.col(label).alias("g"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    c = centroids(e, "g", "v").select(F.col("group").alias("c"), "n", "centroid")
    x = e.withColumn("_i", F.monotonically_increasing_id()).join(F.broadcast(c)).select("g", "_i", "c", far(F.col("v"), F.col("centroid")).alias("d"))  # few groups
    own = F.col("g") == F.col("c")
    row = x.groupBy("_i", "g").agg(F.max(F.when(own, F.col("d"))).alias("d"), F.min(F.when(~own, F.sqrt("d"))).alias("b"))
    a = F.sqrt("d")
    per = row.groupBy("g").agg(F.avg(a).alias("s"), F.sum("d").alias("w"), F.sum((F.col("b") - a) / F.greatest(F.col("b"), a)).alias("sil"), F.count(F.lit(1)).alias("n")).join(c.select(F.col("c").alias("g"), "centroid"), "g")
    pair = per.alias("x").join(per.alias("y"), F.col("x.g") != F.col("y.g"))
    worst = pair.groupBy("x.g").agg(F.max((F.col("x.s") + F.col("y.s")) / F.sqrt(far(F.col("x.centroid"), F.col("y.centroid")))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    mid = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mid"))  # one number a dimension
    t = per.crossJoin(F.broadcast(mid)).agg(F.sum(F.col("n") * far(F.col("centroid"), F.col("mid"))).alias("b"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum("sil") / F.sum("n")).alias("silhouette"), F.min("n").alias("least"))  # one row
    ch = F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k")))
    return t.crossJoin(worst).select(ch.alias("calinski_harabasz"), "davies_bouldin", "silhouette", "least", "n")  # one row each


def k_selection(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 7) -> DataFrame:
    """(k, calinski_harabasz, davies_bouldin, silhouette, least, chosen) of k-means for each ``k`` on unit vectors.

    Chosen is the first by Calinski-Harabasz, silhouette and low Davies-Bouldin of those whose smallest group has
    three rows and a hundredth of all at least; if there is none, of all. Ties go to the smaller k."""
    u = df.where(F.col(key).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(key).alias("key"), unit(F.col(vector)).alias("v"))
    out = None
    for k in ks:
        one = label_scatter(kmeans_labels(u, "key", "v", k, seed).join(u, "key"), "cluster", "v").withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    fine = (F.col("least") >= F.greatest(F.lit(3.0), F.col("n") / 100)).cast("int")
    order = F.struct(fine, "calinski_harabasz", "silhouette", -F.col("davies_bouldin"), -F.col("k"))
    best = F.max(order).over(Window.partitionBy())  # a row per k
    return out.withColumn("chosen", order == best).select("k", "calinski_harabasz", "davies_bouldin", "silhouette", "least", "chosen")
