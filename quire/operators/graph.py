"""Operators on graphs given as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, drop


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(id, component): every node of ``edges`` with the smallest id it is connected to.

    Alternates linking every node's larger neighbours to its smallest one and every smaller
    neighbour likewise (large-star and small-star), which ends after about log(n) steps even on
    long chains. Self-loops count as nodes; null ends are dropped. Raises if ``most_steps`` don't do.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    now = cut(e.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(most_steps):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        fresh = cut(small)
        same = now.count() == fresh.count() and now.exceptAll(fresh).isEmpty()
        drop(now)
        now = fresh
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {most_steps} steps")
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("m")), F.col("id") == F.col("u"), "left").select(
        "id", F.coalesce("m", "id").alias("component")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b; loops and null ends are dropped."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def shared_hub_pairs(membership: DataFrame, hub: str, item: str, least: int = 1, largest_hub: int | None = None) -> DataFrame:
    """(a, b, n): items that share at least ``least`` hubs, a < b. Hubs of more than ``largest_hub``
    items are skipped where that is given; items in fewer than ``least`` hubs are dropped first."""
    m = membership.select(F.col(hub).alias("h"), F.col(item).alias("i")).where("h is not null and i is not null").distinct()
    if least > 1:
        m = m.join(m.groupBy("i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("i"), "i", "left_semi")
    if largest_hub is not None:
        m = m.join(m.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= largest_hub).select("h"), "h", "left_semi")
    pairs = m.alias("x").join(m.alias("y"), "h").where("x.i < y.i")
    return pairs.groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def overlapping_sets(membership: DataFrame, owner: str, element: str, least_shared, enough, block: int = 2000) -> DataFrame:
    """(a, b, n, sa, sb): owners a < b that share ``n`` elements of their ``sa`` and ``sb``, where ``enough(n, sa, sb)``.

    ``least_shared(s)`` is the smallest ``n`` that a set of ``s`` elements can be enough with, and ``enough`` must
    stay true as ``n`` grows. Equal sets are one class. Classes meet on the elements of their prefixes, rarest first,
    and only on the first element they share, so each pair is made once and nothing is counted by a shuffle; what
    follows in both sets, and the common bits of their signatures with each set's elements that share a bit, bound
    ``n`` before the sets are compared. Elements of many classes are met in blocks.
    """
    m = membership.select(F.col(owner).alias("o"), F.col(element).alias("e")).where("o is not null and e is not null").distinct()
    rank = cut(m.groupBy("e").agg(F.count(F.lit(1)).alias("m")).orderBy("m", "e").select("e", F.monotonically_increasing_id().alias("r")))
    sets = cut(m.join(rank, "e").groupBy("o").agg(F.array_sort(F.collect_list("r")).alias("e")).where(F.size("e") >= least_shared(F.size("e"))))
    bits = F.expr("aggregate(e, 0L, (g, r) -> g | shiftleft(1L, cast(r % 64 as int)))")
    classes = sets.groupBy("e").agg(F.min("o").alias("id")).withColumn("s", F.size("e")).withColumn("g", bits)
    classes = cut(classes.withColumn("lost", F.col("s") - F.bit_count("g")))
    of = cut(sets.join(classes, "e").select("o", "id", "s"))
    p = classes.select("id", "e", "s", "g", "lost", F.posexplode(F.slice("e", F.lit(1), F.col("s") - least_shared(F.col("s")) + 1)).alias("i", "r"))
    p = p.join(p.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "r")
    x = p.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).alias("x")
    y = p.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    common = F.bit_count(F.col("x.g").bitwiseAND(F.col("y.g"))) + F.least("x.lost", "y.lost")
    most = F.least(F.col("x.s") - F.col("x.i"), F.col("y.s") - F.col("y.i"), common)
    both = F.array_intersect("x.e", "y.e")
    met = x.join(y, ["r", "block"]).where("x.id < y.id").where(enough(most, F.col("x.s"), F.col("y.s")))
    met = met.where((both[0] == F.col("r")) & enough(F.size(both), F.col("x.s"), F.col("y.s")))
    pairs = met.select(F.col("x.id").alias("ida"), F.col("y.id").alias("idb"), F.size(both).cast("bigint").alias("n"))
    side = lambda k: of.select(F.col("o").alias(k), F.col("id").alias(f"id{k}"), F.col("s").alias(f"s{k}"))
    apart = pairs.join(side("a"), "ida").join(side("b"), "idb")
    first = F.col("a") < F.col("b")
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", F.when(first, F.col("sa")).otherwise(F.col("sb")).alias("sa"), F.when(first, F.col("sb")).otherwise(F.col("sa")).alias("sb"))
    same = side("a").join(side("b"), F.col("ida") == F.col("idb")).where("a < b").where(enough(F.col("sa"), F.col("sa"), F.col("sb")))
    return apart.union(same.select("a", "b", F.col("sa").cast("bigint"), "sa", "sb"))


def similar_sets(membership: DataFrame, owner: str, element: str, least: float) -> DataFrame:
    """(a, b, jaccard) of owners whose element sets have at least ``least`` of their union in common."""
    share = lambda n, sa, sb: n / (sa + sb - n)
    p = overlapping_sets(membership, owner, element, lambda s: F.greatest(F.lit(1), F.ceil(least * s - 1e-9).cast("int")), lambda n, sa, sb: share(n, sa, sb) >= least)
    return p.select("a", "b", share(F.col("n"), F.col("sa"), F.col("sb")).alias("jaccard"))


def degrees(pairs: DataFrame, weight: str = "n") -> DataFrame:
    """(id, degree, weighted, centrality) of an undirected edge table (a, b, weight)."""
    both = pairs.select(F.col("a").alias("id"), F.col(weight).alias("w")).union(pairs.select("b", weight))
    d = both.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weighted"))
    many = d.agg((F.count(F.lit(1)) - 1).alias("_m"))
    return d.crossJoin(F.broadcast(many)).withColumn("centrality", F.try_divide(F.col("degree"), F.col("_m"))).drop("_m")  # one row


def labelled(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """Edges whose both ends have a label, with src_label and dst_label."""
    side = lambda x: labels.select(F.col(node).alias(x), F.col(label).alias(f"{x}_label")).where(F.col(f"{x}_label").isNotNull())
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def insularity(edges: DataFrame) -> DataFrame:
    """(label, n_out, n_internal, percent_internal) of labelled edges; per label of the source."""
    same = F.col("src_label") == F.col("dst_label")
    return edges.groupBy(F.col("src_label").alias("label")).agg(F.count(F.lit(1)).alias("n_out"), F.count_if(same).alias("n_internal")).withColumn(
        "percent_internal", 100 * F.try_divide(F.col("n_internal"), F.col("n_out"))
    )


def modularity(edges: DataFrame, least_nodes: int = 10) -> DataFrame:
    """One row with ``q``: the partition's modularity on the simple undirected graph of labelled
    edges; null with fewer than ``least_nodes`` nodes."""
    e = edges.where("src <> dst").select(
        F.when(F.col("src") < F.col("dst"), F.struct(F.col("src").alias("a"), F.col("src_label").alias("la"), F.col("dst").alias("b"), F.col("dst_label").alias("lb")))
        .otherwise(F.struct(F.col("dst").alias("a"), F.col("dst_label").alias("la"), F.col("src").alias("b"), F.col("src_label").alias("lb"))).alias("x")
    ).select("x.*").distinct()
    ends = e.select(F.col("a").alias("id"), F.col("la").alias("label")).union(e.select("b", "lb"))
    nodes = ends.agg(F.countDistinct("id").alias("nodes"), (F.count(F.lit(1)) / 2).alias("m"))
    degree = ends.groupBy("label").agg(F.count(F.lit(1)).alias("d"))
    inside = e.where("la = lb").groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("l"))
    part = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return degree.join(inside, "label", "left").crossJoin(F.broadcast(nodes)).agg(  # one row
        F.when(F.max("nodes") >= least_nodes, F.sum(part)).alias("q"), F.max("nodes").alias("n_nodes"), F.max("m").cast("bigint").alias("n_edges")
    )


def participation(edges: DataFrame) -> DataFrame:
    """(id, participation): 1 less the squared shares of the labels among a node's targets."""
    n = edges.groupBy(F.col("src").alias("id"), "dst_label").agg(F.count(F.lit(1)).alias("k"))
    return n.groupBy("id").agg((1 - F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("participation"))


def closure(merges: DataFrame, most_steps: int = 32) -> DataFrame:
    """(id, root) of a merge map (src, dst), one target per source: pointer jumping to the last
    target. Members of a cycle, and what leads into one, are dropped."""
    now = cut(merges.where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst")))
    for _ in range(most_steps):
        step = now.alias("x").join(now.select(F.col("src").alias("k"), F.col("dst").alias("next")), F.col("x.dst") == F.col("k"), "left")
        jumped = cut(step.select("src", F.coalesce("next", "dst").alias("dst"), F.col("k").isNotNull().alias("moved")))
        now = jumped.select("src", "dst")
        if jumped.where("moved and src <> dst").isEmpty():
            break
    ends = now.where("src <> dst")
    return ends.join(now.select(F.col("src").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id"), F.col("dst").alias("root"))


def redirect(edges: DataFrame, roots: DataFrame, kind: list[str], sums: list[str]) -> DataFrame:
    """Edges with merged ends put in place of their sources: loops dropped, equal edges folded by sum."""
    r = lambda x: roots.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root"))
    e = edges.join(r("src"), "src", "left").join(r("dst"), "dst", "left")
    e = e.select(F.coalesce("src_root", "src").alias("src"), F.coalesce("dst_root", "dst").alias("dst"), *kind, *sums).where("src <> dst")
    return e.groupBy("src", "dst", *kind).agg(*(F.sum(s).alias(s) for s in sums))


def ancestors(is_a: DataFrame, most_depth: int = 5) -> DataFrame:
    """(id, ancestor, depth): everything reached upwards, at its least depth; cycles are safe."""
    step = is_a.select(F.col("src").alias("id"), F.col("dst").alias("ancestor")).where("id <> ancestor").distinct()
    known = front = cut(step.withColumn("depth", F.lit(1)))
    for depth in range(2, most_depth + 1):
        up = front.join(step.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor")
        front = cut(up.select("id", F.col("next").alias("ancestor")).where("id <> ancestor").distinct().join(known, ["id", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front))
    return known


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, weight: str | None = None, most_steps: int = 200) -> DataFrame:
    """(id, rank), summing to 1; nodes without out-edges give to all.

    What those nodes give is the same for every node, so the ranks are in proportion to the solution of
    x = 1 + damping * P'x, which needs no sum over all nodes from step to step. Steps go on, five between
    two kept tables, until the ranks move by less than ``tolerance`` of their sum; else an error is raised.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.groupBy("src", "dst").agg(F.sum(w).alias("w"))
    e = cut(e.join(e.groupBy("src").agg(F.sum("w").alias("t")), "src").select("src", "dst", (damping * F.col("w") / F.col("t")).alias("p")))
    x = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("x", F.lit(1.0)))
    for _ in range(0, most_steps, 5):
        now = x.select("id", "x", F.col("x").alias("before"))
        for _ in range(5):
            got = e.join(now.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("p")).alias("g"))
            now = now.select("id", "x").alias("n").join(got, "id", "left").select("id", (1 + F.coalesce("g", F.lit(0.0))).alias("x"), F.col("n.x").alias("before"))
        fresh = cut(now)
        drop(x)
        x = fresh
        moved, whole = x.agg(F.sum(F.abs(F.col("x") - F.col("before"))), F.sum("x")).first()
        if moved is None or moved <= tolerance * whole:
            return x.select("id", (F.col("x") / F.lit(whole or 1.0)).alias("rank"))
    raise RuntimeError(f"ranks still move after {most_steps} steps")


def eigenvector_centrality(pairs: DataFrame, weight: str = "n", tolerance: float = 1e-6, most_steps: int = 100) -> DataFrame:
    """(id, centrality), of unit length, by power iteration on the undirected graph plus its identity, five
    steps between two kept tables, until a step moves the values by less than ``tolerance`` on average. Where ``most_steps``
    don't do, as on graphs of several equal parts, the weighted degrees of unit length are given instead."""
    both = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(weight).cast("double").alias("w")).union(pairs.select("b", "a", F.col(weight).cast("double"))))
    degree = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("v"))
    top = degree.agg(F.max("v")).first()[0] or 1.0

    def unit(v):
        norm = v.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 1.0
        return v.withColumn("v", F.col("v") / F.lit(norm))

    raw = cut(degree)
    v = unit(raw)
    for _ in range(0, most_steps, 5):
        now = v.select("id", "v", F.col("v").alias("was"))
        for _ in range(5):
            got = both.join(now.select(F.col("id").alias("src"), "v"), "src").groupBy(F.col("dst").alias("id")).agg((F.sum(F.col("v") * F.col("w")) / top).alias("g"))
            now = now.select("id", "v").join(got, "id", "left").select("id", (F.col("v") / top + F.coalesce("g", F.lit(0.0))).alias("v"), F.col("v").alias("was"))
        fresh = cut(now)
        drop(raw)
        raw, v = fresh, unit(fresh)
        grown, was, m = fresh.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.sqrt(F.sum(F.col("was") * F.col("was"))), F.count(F.lit(1))).first()
        moved = fresh.agg(F.sum(F.abs(F.col("v") / F.lit(grown or 1.0) - F.col("was") / F.lit(was or 1.0)))).first()[0]
        if moved is None or moved <= tolerance * m:
            return v.select("id", F.col("v").alias("centrality"))
    return unit(degree).withColumnRenamed("v", "centrality")


def label_communities(pairs: DataFrame, steps: int = 8, weight: str = "n") -> DataFrame:
    """(id, community) by label propagation: each step every node takes the label of the greatest
    weight among its neighbours and itself, the smallest of equal ones. Deterministic."""
    both = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(weight).alias("w")).union(pairs.select("b", "a", weight)))
    now = both.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(steps):
        votes = both.join(now, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "community", "w")
        votes = votes.unionByName(now.withColumn("w", F.lit(1)))
        total = votes.groupBy("id", "community").agg(F.sum("w").alias("w"))
        now = cut(total.groupBy("id").agg(F.min(F.struct(-F.col("w"), F.col("community")))["community"].alias("community")))
    return now


def _moved_to_best(e: DataFrame, whole: float, most_steps: int, seed: int) -> DataFrame:
    """(id, c): nodes of the weighted graph (src, dst, w; both directions, loops once) in communities. In a step about
    half of the nodes, by a hash, move to the neighbouring community that raises modularity most, the smaller of equal
    ones. Ends when no node would gain; raises if ``most_steps`` don't do."""
    state = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
    near = e.where("src <> dst")
    for step in range(most_steps):
        total = state.groupBy("c").agg(F.sum("k").alias("t"))
        votes = near.join(state.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c", "w").unionByName(state.select("id", "c", F.lit(0.0).alias("w")))
        kin = votes.groupBy("id", "c").agg(F.sum("w").alias("w"))
        x = kin.join(total, "c").join(state.select("id", "k", F.col("c").alias("own")), "id")
        here = F.col("c") == F.col("own")
        gain = F.round(F.col("w") - F.col("k") * (F.col("t") - F.when(here, F.col("k")).otherwise(0.0)) / whole, 9)
        best = x.withColumn("g", gain).groupBy("id", "k", "own").agg(F.min(F.struct(-F.col("g"), F.col("c"))).alias("b"), F.max(F.when(here, F.col("g"))).alias("g"))
        wants = (-F.col("b")[best.schema["b"].dataType.names[0]]) > F.col("g") + 1e-9
        turn = F.pmod(F.xxhash64("id", F.lit(step + seed)), F.lit(2)) == 0
        fresh = cut(best.select("id", "k", wants.alias("wants"), F.when(wants & turn, F.col("b")["c"]).otherwise(F.col("own")).alias("c")))
        drop(state)
        state = fresh
        if not state.where("wants").head(1):
            return state.select("id", "c")
    raise RuntimeError(f"communities still change after {most_steps} steps")


def louvain(pairs: DataFrame, weight: str = "n", most_levels: int = 20, most_steps: int = 200, seed: int = 7) -> DataFrame:
    """(id, community) of an undirected weighted graph (a, b, weight): nodes move to the communities that raise
    modularity, communities become nodes, and so on until none moves. Deterministic; loops and nulls are dropped.
    A community's id is the smallest of its nodes'."""
    w = F.col(weight).cast("double")
    p = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(w).alias("w")).where("w > 0")
    e = cut(p.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(p.select("b", "a", "w")))
    whole = e.agg(F.sum("w")).first()[0]
    member = cut(e.select(F.col("src").alias("id")).distinct().withColumn("c", F.col("id")))
    if not whole:
        return member.withColumnRenamed("c", "community")
    for level in range(most_levels):
        now = _moved_to_best(e, whole, most_steps, seed + 1000 * level)
        if not now.where("id <> c").head(1):
            break
        to = lambda x: now.select(F.col("id").alias(x), F.col("c").alias(f"{x}_c"))
        member = cut(member.join(to("c"), "c").select("id", F.col("c_c").alias("c")))
        e = cut(e.join(to("src"), "src").join(to("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("w").alias("w")))
    return member.join(member.groupBy("c").agg(F.min("id").alias("community")), "c").select("id", "community")
