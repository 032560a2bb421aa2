"""Vocabularies of clusters: weights, overlaps, distances and what they say of fragmentation.

Rankings break ties by the term; all tables are in long form (cluster, term, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.relational import top_per_group


def term_counts(df: DataFrame, doc: str, cluster: str, terms: str) -> DataFrame:
    """(cluster, term, n, n_docs) of documents with an array of terms; null clusters are left out."""
    one = df.select(F.col(cluster).alias("cluster"), F.col(doc).alias("d"), F.explode(terms).alias("term")).where("cluster is not null")
    by_doc = one.groupBy("cluster", "term", "d").agg(F.count(F.lit(1)).alias("k"))
    return by_doc.groupBy("cluster", "term").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def class_tf_idf(counts: DataFrame, least_clusters: int = 2) -> DataFrame:
    """(cluster, term, weight): share of the cluster's terms times ln(1 + C / (df + 1)), of terms in
    at least ``least_clusters`` clusters; C is the number of clusters, df those with the term."""
    total = counts.groupBy("cluster").agg(F.sum("n").alias("all_"))
    clusters = total.agg(F.count(F.lit(1)).alias("c"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_clusters)
    return (
        counts.join(df, "term").join(total, "cluster").crossJoin(F.broadcast(clusters))  # one row
        .select("cluster", "term", (F.col("n") / F.col("all_") * F.log(1 + F.col("c") / (F.col("df") + 1))).alias("weight"))
    )


def doc_tf_idf(df: DataFrame, doc: str, terms: str, least: int = 2, most_share: float = 0.95) -> DataFrame:
    """(doc, term, weight): counts times ln((1 + N) / (1 + df)) + 1, each document of unit length;
    terms of fewer than ``least`` documents or more than ``most_share`` of them are left out."""
    tf = df.select(F.col(doc).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.agg(F.count(F.lit(1)).alias("N"))
    dfs = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= least) & (F.col("df") <= most_share * F.col("N")))  # one row
    raw = tf.join(dfs, "term").select("doc", "term", (F.col("tf") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_terms(weights: DataFrame, n: int, cluster: str = "cluster", digits: int = 12) -> DataFrame:
    """(cluster, term, place) of the ``n`` heaviest terms; weights count to ``digits``, then the term."""
    return top_per_group(weights, [cluster], [F.desc(F.round("weight", digits)), F.asc("term")], n).select(cluster, "term", "place")


def cluster_pairs(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Every two clusters, a < b: few, by what a cluster is."""
    c = df.select(F.col(cluster).alias("a")).distinct()
    return c.join(c.select(F.col("a").alias("b")), F.col("a") < F.col("b"))


def vocabulary_jaccard(tops: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of every two clusters' top terms."""
    size = tops.groupBy("cluster").agg(F.count(F.lit(1)).alias("s"))
    x, y = tops.select(F.col("cluster").alias("a"), "term"), tops.select(F.col("cluster").alias("b"), "term")
    n = x.join(y, "term").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return (
        cluster_pairs(tops).join(n, ["a", "b"], "left").join(size.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(size.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) / (F.col("sa") + F.col("sb") - F.coalesce("shared", F.lit(0)))).alias("jaccard"))
    )


def rank_biased_overlap(tops: DataFrame, p: float = 0.9, depth: int | None = None) -> DataFrame:
    """(a, b, rbo) of every two ranked lists (cluster, term, place): (1 - p) times the sum over
    depths d, up to the shorter list, of p^(d-1) times the share of the first d terms in both.

    A term at places i and j counts from depth max(i, j) on, so the sum is taken by shared term:
    its part is the tail sum of p^(d-1) / d. Identical lists of n terms give 1 - p^n.
    """
    t = tops if depth is None else tops.where(F.col("place") <= depth)
    size = t.groupBy("cluster").agg(F.max("place").alias("s"))
    x = t.select(F.col("cluster").alias("a"), "term", F.col("place").alias("i"))
    y = t.select(F.col("cluster").alias("b"), "term", F.col("place").alias("j"))
    shared = (
        x.join(y, "term").where("a < b")
        .join(size.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(size.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
        .withColumn("lo", F.greatest("i", "j")).withColumn("hi", F.least("sa", "sb"))
        .where("lo <= hi")
    )
    tail = F.aggregate(F.sequence("lo", "hi"), F.lit(0.0), lambda acc, d: acc + F.pow(F.lit(p), d - 1) / d)
    n = shared.groupBy("a", "b").agg(((1 - p) * F.sum(tail)).alias("rbo"))
    return cluster_pairs(t).join(n, ["a", "b"], "left").select("a", "b", F.coalesce("rbo", F.lit(0.0)).alias("rbo"))


def js_distances(counts: DataFrame) -> DataFrame:
    """(a, b, distance): root of the Jensen-Shannon divergence to base 2 of every two clusters' term
    shares. By terms of both: the others' part is what is left of the shares."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))).select("cluster", "term", "p")
    x, y = p.select(F.col("cluster").alias("a"), "term", F.col("p").alias("p")), p.select(F.col("cluster").alias("b"), "term", F.col("p").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m)
    both = x.join(y, "term").where("a < b").groupBy("a", "b").agg(F.sum(part).alias("s"), F.sum(F.col("p") + F.col("q")).alias("seen"))
    left = 2 - F.coalesce("seen", F.lit(0.0))  # terms of one alone: log2(p / (p / 2)) = 1
    return cluster_pairs(counts).join(both, ["a", "b"], "left").select(
        "a", "b", F.sqrt(F.greatest(F.lit(0.0), (F.coalesce("s", F.lit(0.0)) + left) / 2)).alias("distance")
    )


def flow(edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between two labels, both directions summed, a < b."""
    e = edges.where("src_label <> dst_label")
    return e.groupBy(F.least("src_label", "dst_label").alias("a"), F.greatest("src_label", "dst_label").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def cross_share(edges: DataFrame) -> DataFrame:
    """One row: edges, cross edges, their share, null without edges."""
    cross = F.count_if(F.col("src_label") != F.col("dst_label"))
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), cross.alias("n_cross")).withColumn("s_cross", F.try_divide(F.col("n_cross"), F.col("n_edges")))


def incidence_share(edges: DataFrame) -> DataFrame:
    """One row: cluster incidences of edges (an inner edge has one, a cross edge two), those of inner
    edges, and the share of the rest."""
    inner = F.count_if(F.col("src_label") == F.col("dst_label"))
    x = edges.agg((2 * F.count(F.lit(1)) - inner).alias("total"), inner.alias("intra"))
    return x.withColumn("s_cross", F.try_divide(F.col("total") - F.col("intra"), F.col("total")))


def cohesion_score(distances: DataFrame, flows: DataFrame, cross: DataFrame) -> DataFrame:
    """One row: d_mean, d_weighted by flow, s_cross and csc = 1 - s_cross * d_weighted."""
    x = distances.join(flows, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    d = x.agg(F.avg("distance").alias("d_mean"), F.try_divide(F.sum(F.col("distance") * F.col("n")), F.sum("n")).alias("d_weighted"))
    return d.crossJoin(cross.select("s_cross")).withColumn("csc", 1 - F.col("s_cross") * F.col("d_weighted"))  # one row each


def threshold_sweep(pairs: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n_at_least, n_near): pairs at or above each threshold and within a tenth of it."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in thresholds)))
    v = F.col(value)
    return pairs.select(v, t.alias("threshold")).groupBy("threshold").agg(
        F.count_if(v >= F.col("threshold")).alias("n_at_least"), F.count_if(v.between(F.col("threshold") * 0.9, F.col("threshold") * 1.1)).alias("n_near")
    )


def rao_stirling(shares: DataFrame, distances: DataFrame) -> DataFrame:
    """One row: the sum over ordered pairs of different classes of d * p * q; ``shares`` is (cluster, p)."""
    x = distances.join(shares.select(F.col("cluster").alias("a"), F.col("p").alias("pa")), "a").join(shares.select(F.col("cluster").alias("b"), F.col("p").alias("pb")), "b")
    return x.agg(F.coalesce(2 * F.sum(F.col("distance") * F.col("pa") * F.col("pb")), F.lit(0.0)).alias("rao_stirling"))


def distinctive(membership: DataFrame, cluster: str, record: str, item: str, least_share: float = 0.05, smoothing: float = 0.001) -> DataFrame:
    """(cluster, item, n, share, lift): share of the cluster's records with the item over that of all
    other records plus ``smoothing``; items of at least ``least_share``."""
    m = membership.select(F.col(cluster).alias("cluster"), F.col(record).alias("r"), F.col(item).alias("item")).where("cluster is not null").distinct()
    records = m.select("cluster", "r").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    n = m.where("item is not null").groupBy("cluster", "item").agg(F.count(F.lit(1)).alias("n"))
    # sums over few clusters; the window over items has one row per cluster and item
    x = n.join(records.withColumn("all_", F.sum("size").over(Window.partitionBy())), "cluster").withColumn("everywhere", F.sum("n").over(Window.partitionBy("item")))
    share, other = F.col("n") / F.col("size"), F.try_divide(F.col("everywhere") - F.col("n"), F.col("all_") - F.col("size"))
    return x.select("cluster", "item", "n", share.alias("share"), (share / (F.coalesce(other, F.lit(0.0)) + smoothing)).alias("lift")).where(F.col("share") >= least_share)


def dominance(df: DataFrame, cluster: str, source: str) -> DataFrame:
    """(cluster, n, n_sources, top_source, top_share); the first of tied sources."""
    n = df.groupBy(F.col(cluster).alias("cluster"), F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("cluster").agg(
        F.sum("k").alias("n"), F.count("source").alias("n_sources"), F.min(F.struct(-F.col("k"), F.col("source")))["source"].alias("top_source"), (F.max("k") / F.sum("k")).alias("top_share")
    )


def separation(df: DataFrame, cluster: str, kind: str, a: str, b: str) -> DataFrame:
    """One row: of all pairs of a record of kind a and one of kind b, how many are in different
    clusters; from counts, no pair is made."""
    n = df.groupBy(cluster).agg(F.count_if(F.col(kind) == a).alias("x"), F.count_if(F.col(kind) == b).alias("y"))
    s = n.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("same"))
    return s.select((F.col("sx") * F.col("sy")).alias("pairs"), (F.col("sx") * F.col("sy") - F.col("same")).alias("apart"), (1 - F.try_divide(F.col("same"), F.col("sx") * F.col("sy"))).alias("share_apart"))


def entropies(df: DataFrame, group: str, category: str) -> DataFrame:
    """(group, n, entropy) in nats of the categories' shares within each group."""
    n = df.where(F.col(category).isNotNull()).groupBy(F.col(group).alias("group"), category).agg(F.count(F.lit(1)).alias("k"))
    p = n.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("group")))
    return p.groupBy("group").agg(F.sum("k").alias("n"), (-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def keyword_labels(hits: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(doc, label) of (doc, category, hits): the category of the most hits if it has ``least_share`` of
    all, the first of tied ones; else -1."""
    return hits.groupBy("doc").agg(F.min(F.struct(-F.col("hits"), F.col("category")))["category"].alias("c"), (F.max("hits") / F.sum("hits")).alias("s")).select(
        "doc", F.when(F.col("s") >= least_share, F.col("c")).otherwise(-1).alias("label")
    )


def trends(counts: DataFrame) -> DataFrame:
    """(group, n_years, slope, r2, autocorr1, growth_model, break_year) of yearly counts (group, year, n).

    slope and r2 of a straight line; exponential if ln(n + 1) fits better by 0.1; autocorr1 is the
    centred lag-1 product over the centred squares; break_year is the year before which a second line
    should begin if two lines leave less than 0.8 of the squares one leaves, at least two years each.
    """
    x, y, z = F.col("year").cast("double"), F.col("n").cast("double"), F.log(F.col("n") + 1.0)
    fit = lambda v: (F.try_divide(F.covar_pop(x, v), F.var_pop(x)), F.try_divide(F.pow(F.covar_pop(x, v), 2), F.var_pop(x) * F.var_pop(v)))
    line, expo = fit(y), fit(z)
    flat = counts.groupBy("group").agg(F.count(F.lit(1)).alias("n_years"), line[0].alias("slope"), line[1].alias("r2"), expo[1].alias("r2e"), F.avg(y).alias("mean"), (F.count(F.lit(1)) * (F.var_pop(y) - F.try_divide(F.pow(F.covar_pop(x, y), 2), F.var_pop(x)))).alias("rss"))
    lag = counts.withColumn("before", F.lag("n").over(Window.partitionBy("group").orderBy("year"))).join(flat.select("group", "mean"), "group")
    auto = lag.groupBy("group").agg(F.try_divide(F.sum((F.col("n") - F.col("mean")) * (F.col("before") - F.col("mean"))), F.sum(F.pow(F.col("n") - F.col("mean"), 2))).alias("autocorr1"))
    cuts = counts.select("group", F.col("year").alias("cut"))
    side = F.col("year") < F.col("cut")
    both = counts.join(cuts, "group").groupBy("group", "cut", side.alias("early")).agg(
        F.count(F.lit(1)).alias("m"), (F.count(F.lit(1)) * (F.var_pop(y) - F.coalesce(F.try_divide(F.pow(F.covar_pop(x, y), 2), F.var_pop(x)), F.lit(0.0)))).alias("rss2"))
    two = both.groupBy("group", "cut").agg(F.min("m").alias("m"), F.count(F.lit(1)).alias("sides"), F.sum("rss2").alias("rss2")).where("m >= 2 and sides = 2")
    best = two.groupBy("group").agg(F.min(F.struct(F.round("rss2", 8).alias("rss2"), "cut")).alias("b"))
    return flat.join(auto, "group").join(best, "group", "left").select(
        "group", "n_years", "slope", "r2", "autocorr1", F.when(F.col("r2e") > F.col("r2") + 0.1, "exponential").otherwise("linear").alias("growth_model"),
        F.when(F.col("b.rss2") < 0.8 * F.col("rss"), F.col("b.cut")).alias("break_year"))
