"""Null models, resampling and other seeded procedures. Equal seeds give equal results on equal
partitions of the data; permutations and samples go by hashes of keys, not by row order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.relational import top_per_group
from quire.session import cut


def shuffled_labels(labels: DataFrame, key: str, label: str, draws: int, seed: int = 7) -> DataFrame:
    """(draw, key, label): labels dealt out anew in each draw, each label as often as before.

    Keys are put in the order of a hash of key and draw, labels in that of the keys; both orders are
    numbered per draw, one task per draw, so ``labels`` is meant to hold nodes, not corpus rows.
    """
    d = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("label is not null").crossJoin(F.broadcast(labels.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))))  # a bounded number of draws
    h = F.xxhash64("key", "draw", F.lit(seed))
    a = d.select("draw", "key", F.row_number().over(Window.partitionBy("draw").orderBy(h, "key")).alias("_p"))
    b = d.select("draw", "label", F.row_number().over(Window.partitionBy("draw").orderBy("key")).alias("_p"))
    return a.join(b, ["draw", "_p"]).select("draw", "key", "label")


def cross_share_null(edges: DataFrame, labels: DataFrame, key: str, label: str, draws: int, seed: int = 7) -> DataFrame:
    """(draw, s_cross): share of edges between different labels under shuffled labels."""
    s = shuffled_labels(labels, key, label, draws, seed)
    e = edges.join(s.select("draw", F.col("key").alias("src"), F.col("label").alias("a")), "src").join(s.select("draw", F.col("key").alias("dst"), F.col("label").alias("b")), ["draw", "dst"])
    return e.groupBy("draw").agg(F.avg((F.col("a") != F.col("b")).cast("int")).alias("s_cross"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, i, n): the rows' places from 0 in the order of their key, and how many there are. Sorted parts are
    numbered each by itself and moved on by the sizes of those before, a number a part, so no task holds all."""
    kept = cut(df.select(F.col(key).alias("key")).orderBy("key").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k"))
    ahead = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("ahead"), F.sum("k").over(Window.partitionBy()).alias("n"))  # a row per part
    return kept.join(F.broadcast(ahead), part == F.col("part")).select("key", (F.col("ahead") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"), "n")


def rotated_cross_share(edges: DataFrame, labels: DataFrame, key: str, label: str, draws: int) -> DataFrame:
    """One row (n_draws, observed, mean, sd, z, p_low, p_high): the share of edges (src, dst) between different labels,
    against its null distribution with the labels moved on along the keys, in ``draws`` equal steps around.

    Every draw keeps how often each label occurs and how labels of neighbouring keys go together. The shares at or
    beyond the observed one count with one more, as empirical p. Keys without a label, and their edges, are left out."""
    l = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"))
    at = numbered(l, "key")
    place = cut(at.join(l, "key"))
    by_place = place.select(F.col("i").alias("j"), "label")
    e = edges.select("src", "dst").join(place.select(F.col("key").alias("src"), F.col("i").alias("ia"), "n"), "src").join(place.select(F.col("key").alias("dst"), F.col("i").alias("ib")), "dst")
    e = e.select("ia", "ib", "n", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))
    moved = lambda i: (F.col(i) + F.col("draw") * F.floor(F.col("n") / (draws + 1))) % F.col("n")
    x = e.select("draw", moved("ia").alias("ja"), moved("ib").alias("jb"))
    x = x.join(by_place.select(F.col("j").alias("ja"), F.col("label").alias("a")), "ja").join(by_place.select(F.col("j").alias("jb"), F.col("label").alias("b")), "jb")
    s = x.groupBy("draw").agg(F.avg((F.col("a") != F.col("b")).cast("int")).alias("s"))
    null = F.col("draw") > 0
    seen = s.agg(F.max(F.when(~null, F.col("s"))).alias("observed"))
    t = s.crossJoin(F.broadcast(seen)).agg(  # one row
        F.count_if(null).alias("n_draws"), F.max("observed").alias("observed"), F.avg(F.when(null, F.col("s"))).alias("mean"), F.stddev_samp(F.when(null, F.col("s"))).alias("sd"),
        F.count_if(null & (F.col("s") <= F.col("observed"))).alias("low"), F.count_if(null & (F.col("s") >= F.col("observed"))).alias("high"))
    return t.select("n_draws", "observed", "mean", "sd", F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")).alias("z"), ((1 + F.col("low")) / (1 + F.col("n_draws"))).alias("p_low"), ((1 + F.col("high")) / (1 + F.col("n_draws"))).alias("p_high"))


def random_ranking(queries: DataFrame, docs: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(query, doc, place): k documents a query in the order of a hash, a ranking that knows nothing.

    Documents are in hash order already by a bucket, of which each query takes those next to its own
    hash, so that no query meets all documents."""
    n = docs.count()
    buckets = max(1, n // (4 * k))
    q = queries.select(F.col("id").alias("query")).distinct().withColumn("b", F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(buckets)))
    near = q.select("query", F.explode(F.array(*(F.pmod(F.col("b") + i, F.lit(buckets)) for i in range(min(3, buckets))))).alias("b")).distinct()
    d = docs.select(F.col("id").alias("doc")).distinct().withColumn("b", F.pmod(F.xxhash64("doc", F.lit(seed + 1)), F.lit(buckets)))
    x = near.join(d, "b").where("query <> doc")
    return top_per_group(x, ["query"], [F.xxhash64("query", "doc", F.lit(seed)), F.asc("doc")], k).select("query", "doc", "place")


def stratified(df: DataFrame, key: str, strata: str, share: float, least: int = 2, seed: int = 7) -> DataFrame:
    """About ``share`` of each stratum by the lowest hashes, rounded up; strata smaller than ``least``
    are kept whole, null is a stratum."""
    h = F.xxhash64(key, F.lit(seed))
    n = df.groupBy(F.col(strata).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    x = df.join(n, df[strata].eqNullSafe(n["_s"])).withColumn("_p", F.row_number().over(Window.partitionBy("_s").orderBy(h, key)))
    return x.where((F.col("_n") < least) | (F.col("_p") <= F.ceil(F.col("_n") * share))).drop("_s", "_n", "_p")


def bootstrap_stability(df: DataFrame, key: str, vector: str, k: int, draws: int = 6, share: float = 0.9, seed: int = 7) -> DataFrame:
    """One row (median_ari, iqr): k-means on ``draws`` samples of ``share`` of the rows, and the
    adjusted Rand indices of every two of them on the rows both hold."""
    from quire.operators.vectors import kmeans_labels, rand_index

    runs = []
    for d in range(draws):
        part = df.where(F.pmod(F.xxhash64(key, F.lit(seed + d)), F.lit(1000)) < int(1000 * share))
        runs.append(kmeans_labels(part, key, vector, k, seed + d).withColumnRenamed("cluster", f"c{d}"))
    aris = []
    for i in range(draws):
        for j in range(i + 1, draws):
            aris.append(rand_index(runs[i].join(runs[j], key), f"c{i}", f"c{j}"))
    out = aris[0]
    for a in aris[1:]:
        out = out.union(a)
    return out.agg(F.percentile("ari", 0.5).alias("median_ari"), (F.percentile("ari", 0.75) - F.percentile("ari", 0.25)).alias("iqr"))


def co_association(label_sets: DataFrame) -> DataFrame:
    """(a, b, share): how often two items are in one cluster, of the runs that hold both; of pairs that
    ever are. ``label_sets`` is (run, item, cluster), a sample: clusters make pairs of their items."""
    runs = label_sets.groupBy("item").agg(F.collect_set("run").alias("r"))
    x, y = (label_sets.select("run", "cluster", F.col("item").alias(s)) for s in "ab")
    n = x.join(y, ["run", "cluster"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(runs.select(F.col("item").alias("a"), F.col("r").alias("ra")), "a").join(runs.select(F.col("item").alias("b"), F.col("r").alias("rb")), "b")
    return both.select("a", "b", (F.col("n") / F.size(F.array_intersect("ra", "rb"))).alias("share"))


def _numbered(labels: DataFrame) -> DataFrame:
    """(id, label, number) of labelled nodes: numbers from 0 without gaps, in order of label and id."""
    kept = cut(labels.where("label is not null").orderBy("label", "id").select("id", "label", F.monotonically_increasing_id().alias("i")))
    part = F.shiftright("i", 33)
    many = kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    before = np.cumsum([0, *(r["n"] for r in many)]).tolist()
    first = kept.sparkSession.createDataFrame([(r["part"], n) for r, n in zip(many, before)], "part long, before long")
    return kept.withColumn("part", part).join(F.broadcast(first), "part").select("id", "label", (F.col("before") + F.col("i") - F.shiftleft("part", 33)).alias("number"))


#: Edges whose swaps are made in one step of numpy.
STEP = 1 << 18
#: Edges sent to a draw's task in one value: small, as an Arrow batch holds up to 10,000 of them.
PACKED = 128


def _gathered(parts: Iterable[np.ndarray]) -> np.ndarray:
    """The numbers of all parts, sorted, each once; 10 bytes a number while they come."""
    x, n = np.empty(STEP, dtype=np.int64), 0
    for part in parts:
        if n + len(part) > len(x):
            x.resize(max(n + len(part), len(x) + len(x) // 4), refcheck=False)
        x[n : n + len(part)] = part
        n += len(part)
    x.resize(n, refcheck=False)
    x.sort()
    n, last = 0, -1
    for lo in range(0, len(x), STEP):
        part = x[lo : lo + STEP]
        kept, last = part[np.diff(part, prepend=last) != 0], part[-1]
        x[n : n + len(kept)] = kept
        n += len(kept)
    x.resize(n, refcheck=False)
    return x


def _slots(x: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of so many bits, 1 to 63."""
    return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


def _twice(*arrays: np.ndarray) -> np.ndarray:
    """The numbers that come more than once in all arrays, sorted. A sixteenth, by its hash, is copied and sorted at a time."""
    if sum(map(len, arrays)) <= STEP:
        x = np.sort(np.concatenate(arrays))
        return np.unique(x[1:][x[1:] == x[:-1]])
    steps = [x[lo : lo + STEP] for x in arrays for lo in range(0, len(x), STEP)]
    slots = [_slots(x, 4).astype(np.uint8) for x in steps]
    sizes = sum(np.bincount(at, minlength=16) for at in slots)
    room, twice = np.empty(sizes.max(), dtype=np.int64), []
    for k in range(16):
        n = 0
        for x, at in zip(steps, slots, strict=True):
            x = x[at == k]
            room[n : n + len(x)] = x
            n += len(x)
        x = room[:n]
        x.sort()
        twice.append(np.unique(x[1:][x[1:] == x[:-1]]))
    return np.sort(np.concatenate(twice))


def _among(few: np.ndarray):
    """Which of some numbers are in ``few``, which is sorted, as a function: most are told by a table of hashes."""
    bits = max(8, (16 * len(few)).bit_length())
    table = np.zeros(1 << bits, dtype=bool)
    table[_slots(few, bits)] = True

    def among(x: np.ndarray) -> np.ndarray:
        found = table[_slots(x, bits)]
        at = np.flatnonzero(found)
        if len(at):
            found[at] = few[np.minimum(np.searchsorted(few, x[at]), len(few) - 1)] == x[at]
        return found

    return among


def swapped(edges: np.ndarray, rounds: int, rng: np.random.Generator, swaps: int = 0) -> np.ndarray:
    """The edges of a simple graph, numbers a < b as a << 32 | b, after ``rounds`` of swaps of ends, and more rounds until
    ``swaps`` are made or ten times as many rounds are over; in place, some 20 bytes an edge.

    In a round the edges are paired at random and each pair proposes one of its two swaps. It is made unless a loop
    comes of it or one of the pair's four edges, present and proposed, comes twice among those of all pairs. As a swap
    leaves these as they are, each round can be undone by the same chance, and all graphs of the degrees are equally likely.
    """
    half, low = len(edges) // 2, (1 << 32) - 1
    made = np.empty(2 * half, dtype=np.int64)
    over = done = 0
    while over < rounds or done < swaps and over < 10 * rounds:
        rng.shuffle(edges)
        for lo in range(0, half, STEP):
            e, f = edges[lo : min(lo + STEP, half)], edges[half + lo : half + min(lo + STEP, half)]
            turn = rng.random(len(e)) < 0.5
            a, b, c, d = e >> 32, e & low, np.where(turn, f >> 32, f & low), np.where(turn, f & low, f >> 32)
            made[lo : lo + len(e)] = np.minimum(a, c) << 32 | np.maximum(a, c)
            made[half + lo : half + lo + len(e)] = np.minimum(b, d) << 32 | np.maximum(b, d)
        among = _among(_twice(edges, made))
        for lo in range(0, half, STEP):
            hi = min(lo + STEP, half)
            four = edges[lo:hi], edges[half + lo : half + hi], made[lo:hi], made[half + lo : half + hi]
            ok = ~(among(four[0]) | among(four[1]) | among(four[2]) | among(four[3]))
            for x in four[2:]:
                ok &= x >> 32 != x & low
            np.copyto(four[0], four[2], where=ok)
            np.copyto(four[1], four[3], where=ok)
            done += int(ok.sum())
        over += 1
    return edges


def null_modularity(edges: DataFrame, labels: DataFrame, draws: int = 1000, swaps_per_edge: int = 10, seed: int = 7) -> DataFrame:
    """(draw, q): modularity of a partition on graphs with the same degrees, each made of the given one by swapping the
    ends of pairs of edges, ``swaps_per_edge`` swaps made for each edge where the graph allows that.

    Draws and swaps are the reference's by default. Twice as many tasks as there are cores each get the edges once, as numbers, and make
    their draws one after the other, each from the given graph and its own seed. A task holds some 24 bytes an edge, which bounds
    this to graphs that fit a task; ``edges`` is (a, b), ``labels`` is (id, label). Nodes without a label are left out."""
    nodes = cut(_numbered(labels))
    # nodes are numbered by label, so a label is told by its first number
    first = np.array([r["first"] for r in nodes.groupBy("label").agg(F.min("number").alias("first")).orderBy("first").select("first").collect()], dtype=np.int64)  # a row per label
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(first)
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("number").alias(f"n{x}"))
    ends = edges.join(side("a"), "a").join(side("b"), "b").select("na", "nb")
    groups = max(1, min(draws, 2 * spark.sparkContext.defaultParallelism))

    def packed(batches):
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            keys = (np.minimum(a, b) << 32 | np.maximum(a, b))[a != b]
            if len(keys):
                rows = [keys[lo : lo + PACKED].tobytes() for lo in range(0, len(keys), PACKED)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["keys"])

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def parts():
            nonlocal group
            for batch in batches:
                if len(batch):
                    group = batch.column("group")[0].as_py()  # the same in all of a partition
                    yield np.frombuffer(b"".join(batch.column("keys").to_pylist()), dtype=np.int64)

        keys = _gathered(parts())
        if group is None:
            return
        # the given graph is kept in 4 bytes an edge: how many edges go from each node, and where to
        m, upto = len(keys), np.searchsorted(keys, np.arange((keys[-1] >> 32) + 2) << 32)
        many, to = np.diff(upto), keys.astype(np.uint32)
        del keys
        starts = shared.value

        def modularity(draw: int) -> float:
            keys = np.repeat(np.arange(len(many)), many)
            keys <<= 32
            keys |= to
            swapped(keys, 2 * swaps_per_edge, np.random.default_rng(seed + draw), swaps_per_edge * m)
            inside, degree = np.zeros(len(starts)), np.zeros(len(starts))
            for lo in range(0, m, STEP):
                x = keys[lo : lo + STEP]
                la, lb = (np.searchsorted(starts, n, side="right") - 1 for n in (x >> 32, x & ((1 << 32) - 1)))
                inside += np.bincount(la[la == lb], minlength=len(starts))
                degree += np.bincount(la, minlength=len(starts)) + np.bincount(lb, minlength=len(starts))
            return float((inside / m - (degree / (2 * m)) ** 2).sum())

        for draw in range(group, draws, groups):
            yield pa.RecordBatch.from_arrays([pa.array([draw], pa.int32()), pa.array([modularity(draw)])], ["draw", "q"])

    d = ends.mapInArrow(packed, "keys binary").crossJoin(F.broadcast(spark.range(groups).select(F.col("id").cast("int").alias("group"))))  # a bounded number of groups
    return d.repartitionById(groups, "group").mapInArrow(swap, "draw int, q double")  # each group a task of its own


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness) on an undirected, unweighted graph (a, b) by Brandes' accumulation.

    Tasks take the sources in groups, each with the whole graph, which bounds this to graphs that fit
    a task; ``sources`` (id) limits it to a sample, scaled up. Pairs count once."""
    spark = edges.sparkSession
    graph = edges.select("a", "b").where("a <> b").distinct()
    nodes = graph.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    n = nodes.count()
    if n > 200_000:
        raise ValueError("give a smaller graph: each task holds all of it")
    rows = graph.toPandas()  # checked above
    names = np.unique(rows.to_numpy().ravel()) if len(rows) else np.array([])
    ends = np.searchsorted(names, rows.to_numpy()) if len(rows) else np.zeros((0, 2), int)
    near: list[list[int]] = [[] for _ in names]
    for x, y in ends.tolist():
        near[x].append(y)
        near[y].append(x)
    shared = spark.sparkContext.broadcast((names, near))
    asked = nodes if sources is None else nodes.join(sources.select("id"), "id", "left_semi")
    scale = n / max(1, asked.count()) / 2
    kind = nodes.schema["id"].dataType.simpleString()

    def gather(batches):
        ids, adj = shared.value
        total = np.zeros(len(ids))
        for pdf in batches:
            for s in np.searchsorted(ids, pdf["id"].to_numpy()):
                far, paths, order = {s: 0}, {s: 1.0}, [s]
                before: dict[int, list[int]] = {s: []}
                for v in order:
                    for w in adj[v]:
                        if w not in far:
                            far[w], paths[w], before[w] = far[v] + 1, 0.0, []
                            order.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                    if w != s:
                        total[w] += share[w]
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"id": ids[at], "v": total[at]})

    got = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(gather, f"id {kind}, v double").groupBy("id").agg((F.sum("v") * scale).alias("v"))
    return nodes.join(got, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("betweenness"))


def neighbour_joining(names: list[str], distance: np.ndarray):
    """A tree of (children, length) pairs by neighbour joining, for driver-sized matrices; ties go to
    the first pair. Fits :func:`quire.sources.writers.newick`."""
    d, nodes = np.asarray(distance, float).copy(), [(n, 0.0) for n in names]
    while len(nodes) > 2:
        n = len(nodes)
        r = d.sum(1)
        q = (n - 2) * d - r[:, None] - r[None, :]
        np.fill_diagonal(q, np.inf)
        i, j = divmod(int(np.round(q, 12).argmin()), n)
        li = d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2))
        joined = ([(nodes[i][0], max(0.0, li)), (nodes[j][0], max(0.0, d[i, j] - li))], 0.0)
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        d = np.vstack([np.column_stack([d[np.ix_(keep, keep)], row[keep]]), np.append(row[keep], 0.0)])
        nodes = [nodes[k] for k in keep] + [joined]
    if len(nodes) == 2:
        return ([(nodes[0][0], d[0, 1] / 2), (nodes[1][0], d[0, 1] / 2)], 0.0)
    return nodes[0] if nodes else ([], 0.0)
