"""Most similar vectors for every vector, by robust-pruned graphs over overlapping shards.

The vectors of lowest hash serve as centres. Every vector goes to the shards of its nearest centres,
so that two similar ones share at least one; each shard builds its own graph and is searched by all
its members. Shards of more than a bounded number of members are split; their members then search
every part. Results of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.graph_index import beam_search, build, neighbours, similarities
from quire.session import cut

#: Vectors per centre, and the most centres: their matrix goes to all executors (12 MB at 384 numbers).
PER_CENTRE, MOST_CENTRES = 150, 8192
#: The shards a vector goes to.
SPILL = 3
#: Beyond each of these numbers of centres a vector goes to one shard more: among many centres two similar vectors
#: less often have one of their nearest in common (README).
MORE_FROM = (500, 1500, 4000)
#: The most members of one graph (30 MB at 384 numbers).
MOST_MEMBERS = 20_000
DEGREE, BEAM = 16, 48
#: One of at most so many vectors tells how large the cells are.
SIZED = 16


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, v): one vector per key, those of exactly ``dims`` finite numbers that are not all zero.

    Null keys are dropped; of different vectors of a key the smallest counts.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.where(F.col(key).isNotNull() & (F.size(v) == dims))
        .where(finite & F.exists(v, lambda x: x != 0))
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(v).alias("v"))
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit rows of a column of lists of ``dims`` numbers."""
    x = np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _search(x: np.ndarray, stored: np.ndarray, asks: np.ndarray, k: int, beam: int) -> np.ndarray:
    """For each row of ``x`` that asks its ``k`` nearest others among the stored rows, as row numbers, -1 for none."""
    at = np.nonzero(stored)[0]
    ids = np.full((len(x), k), -1)
    if not len(at) or not asks.any():
        return ids
    y = x[at]
    whole = similarities(y)
    graph = build(y, DEGREE, beam, whole=whole)
    own = np.nonzero(asks[at])[0]
    got, _ = neighbours(y, graph, k, beam, own, whole)
    ids[at[own]] = np.where(got >= 0, at[got], -1)
    guests = np.nonzero(asks & ~stored)[0]
    for lo in range(0, len(guests), 256):
        g = guests[lo : lo + 256]
        got, _ = beam_search(y, graph, x[g], np.zeros(len(g), dtype=int), 2 * beam)
        got = got[:, :k]
        ids[g, : got.shape[1]] = np.where(got >= 0, at[got], -1)
    return ids


def similar_vectors(
    df: DataFrame, key: str, vector: str, k: int = 5, dims: int = 384, least: float = -1.0, spill: int = SPILL, beam: int = BEAM, asks=None
) -> DataFrame:
    """(key_a, key_b, similarity, place): for each key the at most ``k`` keys of highest cosine
    similarity, of at least ``least``, among all others; ties by the smaller key. ``asks``, a function of
    the key's column, says which keys ask; all answer.

    Unusable vectors (see :func:`usable_vectors`) neither ask nor answer. Fewer than two usable
    vectors give no rows. Approximate: measured recall is in the README.
    """
    usable = cut(usable_vectors(df, key, vector, dims))
    n = usable.count()
    n_centres = max(1, min(MOST_CENTRES, -(-n // PER_CENTRE)))
    low = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    few = usable.where(low < int((1 << 40) * min(1.0, (n_centres + 5 * n_centres**0.5 + 10) / max(1, n))))  # before they are put in order: no more than about the centres move
    some = few.orderBy(low, "key").limit(n_centres).select("v").toArrow().column(0).combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(_matrix(some, dims) if len(some) else np.zeros((1, dims), np.float32))
    spill = min(spill + sum(n_centres > m for m in MORE_FROM), n_centres)

    def cells(x: np.ndarray) -> np.ndarray:
        c = shared.value
        out = []
        for lo in range(0, len(x), 512):
            s = x[lo : lo + 512] @ c.T
            out.append(np.argpartition(-s, spill - 1, axis=1)[:, :spill] if len(c) > spill else np.tile(np.arange(len(c)), (len(s), 1)))
        return np.concatenate(out) if out else np.zeros((0, spill), dtype=np.int64)

    def sizes(batches):
        for b in batches:
            if b.num_rows:
                c, m = np.unique(cells(_matrix(b.column(0), dims)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(m, pa.int64())], ["cell", "m"])

    parts = {}
    if n > MOST_MEMBERS:  # else no cell can be larger; a part of the vectors tells the sizes of cells well enough, and only the sizes of tasks hang on it
        share = max(1, min(SIZED, n // MOST_MEMBERS))
        told = usable.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(share)) == 0).select("v")
        members = told.mapInArrow(sizes, "cell int, m bigint").groupBy("cell").agg((F.sum("m") * share).alias("m"))
        parts = {r["cell"]: -(-r["m"] // MOST_MEMBERS) for r in members.where(F.col("m") > MOST_MEMBERS).collect()}  # at most the centres

    def route(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = _matrix(part.column(1), dims)
                own = cells(x)
                ask = np.asarray(part.column(3))
                row, cell = np.repeat(np.arange(len(x)), own.shape[1]), own.ravel()
                piece, stays = np.zeros(len(row), dtype=np.int64), np.ones(len(row), dtype=bool)
                if parts:
                    many = np.array([parts.get(int(c), 1) for c in cell])
                    h = np.asarray(part.column(2))[row] % many
                    row, cell, h = (np.repeat(a, many) for a in (row, cell, h))
                    piece = np.concatenate([np.arange(m) for m in many])
                    stays = piece == h
                    use = stays | ask[row]
                    row, cell, piece, stays = row[use], cell[use], piece[use], stays[use]
                raw = [r.tobytes() for r in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell * 100_000 + piece, pa.int64()),
                        part.column(0).take(pa.array(row)),
                        pa.array(stays),
                        pa.array(ask[row]),
                        pa.array([raw[i] for i in row], pa.binary()),
                    ],
                    ["shard", "key", "stays", "asks", "unit"],
                )

    kind = usable.schema["key"].dataType.simpleString()
    asking = F.coalesce(asks(F.col("key")), F.lit(False)) if asks else F.lit(True)
    routed = usable.select("key", "v", F.expr("pmod(xxhash64(key), 1000003)").alias("h"), asking.alias("asks")).mapInArrow(
        route, f"shard bigint, key {kind}, stays boolean, asks boolean, unit binary"
    )

    def search(pdf):
        import pandas as pd

        x = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float32).reshape(-1, dims)
        ids = _search(x, pdf["stays"].to_numpy(), pdf["asks"].to_numpy(), k + 1, beam)
        row, place = np.nonzero(ids >= 0)
        other = ids[row, place]
        exact = np.empty(len(row))
        for lo in range(0, len(row), 8192):
            a, b = x[row[lo : lo + 8192]].astype(np.float64), x[other[lo : lo + 8192]].astype(np.float64)
            exact[lo : lo + 8192] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        names = pdf["key"].to_numpy()
        keep = (exact >= least) & (names[row] != names[other])
        return pd.DataFrame({"key_a": names[row[keep]], "key_b": names[other[keep]], "similarity": exact[keep]})

    found = routed.groupBy("shard").applyInPandas(search, f"key_a {kind}, key_b {kind}, similarity double")
    best = Window.partitionBy("key_a").orderBy(F.desc("similarity"), "key_b")  # at most spill * (k + 1) rows unless a shard is split
    return (
        found.groupBy("key_a", "key_b")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
    )
