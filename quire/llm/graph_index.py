"""A robust-pruned directed graph over unit vectors, built and searched in batches of numpy arrays.

Greedy searches propose each point's neighbours; pruning keeps the nearest one and drops those that
it covers within a relaxed distance, so that the kept edges point in diverse directions; edges are
also added backwards and pruned where a point has too many. Searches keep a beam of the best points
seen and expand the best one not expanded yet until all of the beam is.
"""

from __future__ import annotations

import numpy as np

BATCH = 256
#: The most points whose similarities are all made at once (64 MB), by one product of matrices that costs less
#: than gathering vectors at every step; larger sets are gathered. Either way the same numbers up to rounding.
WHOLE = 4096


def similarities(x: np.ndarray) -> np.ndarray | None:
    return x @ x.T if len(x) <= WHOLE else None


def beam_search(
    x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int, table: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities, best first, of the ``beam`` best points seen from each query's ``start``.

    ``graph`` has a row of neighbour ids per point, padded with -1; missing places of the result are -1.
    ``table`` has the queries' similarities to all points, if they are known.
    """
    n, rows = len(x), np.arange(len(queries))
    seen = np.zeros((len(queries), n + 1), dtype=bool)
    seen[:, n] = True
    ids = np.full((len(queries), beam), n)
    sims = np.full((len(queries), beam), -np.inf, dtype=np.float32)
    ids[:, 0] = start
    sims[:, 0] = np.einsum("bd,bd->b", x[start], queries) if table is None else table[rows, start]
    seen[rows, start] = True
    done = np.zeros((len(queries), beam), dtype=bool)
    active = rows
    while len(active):
        open_ = np.where(done[active] | (ids[active] == n), -np.inf, sims[active])
        best = open_.argmax(1)
        left = open_[np.arange(len(active)), best] > -np.inf
        active, best = active[left], best[left]
        if not len(active):
            break
        done[active, best] = True
        near = graph[ids[active, best]]
        near = np.where(near < 0, n, near)
        fresh = ~seen[active[:, None], near]
        near = np.where(fresh, near, n)
        seen[active[:, None], near] = True
        close = np.minimum(near, n - 1)
        got = np.matmul(x[close], queries[active][:, :, None])[:, :, 0] if table is None else table[active[:, None], close]
        got = np.where(fresh, got, -np.inf).astype(np.float32)
        better = (got > sims[active].min(1)[:, None]).any(1)  # else the beam stays as it is
        if not better.any():
            continue
        now = active[better]
        all_ids = np.concatenate([ids[now], near[better]], axis=1)
        all_sims = np.concatenate([sims[now], got[better]], axis=1)
        all_done = np.concatenate([done[now], np.zeros((len(now), near.shape[1]), dtype=bool)], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        take = np.arange(len(now))[:, None]
        ids[now], sims[now], done[now] = all_ids[take, top], all_sims[take, top], all_done[take, top]
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float, whole: np.ndarray | None = None) -> np.ndarray:
    """The kept neighbours of each point out of its ``pool`` row (ids, -1 for none), best first.

    On squared distances: a candidate goes when ``alpha`` times its distance to a kept neighbour is
    at most its distance to the point.
    """
    b, c = pool.shape
    safe = np.maximum(pool, 0)
    far = 2 - 2 * (np.matmul(x[safe], x[points][:, :, None])[:, :, 0] if whole is None else whole[points[:, None], safe])
    bad = (pool < 0) | (pool == points[:, None])
    sorted_pool = np.sort(np.where(bad, -1, pool), axis=1)
    far = np.where(bad, np.inf, far)
    order = np.argsort(far, axis=1, kind="stable")
    take = np.arange(b)[:, None]
    pool, far, safe = pool[take, order], far[take, order], safe[take, order]
    same = np.zeros((b, c), dtype=bool)
    if (np.diff(sorted_pool, axis=1) == 0).any():  # an id can come twice: as found and as an edge that was there
        same[:, 1:] = np.triu(pool[:, :, None] == pool[:, None, :], 1).any(1)[:, 1:]
    alive = np.isfinite(far) & ~same
    if whole is None:
        v = x[safe]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out = np.full((b, degree), -1, dtype=np.int32)
    count = np.zeros(b, dtype=int)
    for k in range(c):
        now = alive[:, k] & (count < degree)
        if not now.any():
            continue
        r = np.nonzero(now)[0]
        out[r, count[r]] = pool[r, k]
        count[r] += 1
        apart = between[r, k] if whole is None else 2 - 2 * whole[pool[r, k][:, None], safe[r]]
        alive[r] &= alpha * apart > far[r]
    return out


def build(x: np.ndarray, degree: int = 16, beam: int = 32, alpha: float = 1.2, seed: int = 7, whole: np.ndarray | None = None) -> np.ndarray:
    """The graph over the unit vectors ``x``: a row of at most ``degree`` ids per point, -1 for none;
    ``whole`` is what :func:`similarities` gives."""
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = max(1, min(degree, n - 1))
    if n <= 1:
        return np.full((n, 1), -1, dtype=np.int32)
    graph = rng.integers(0, n, (n, degree)).astype(np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    middle = int((x @ x.mean(0)).argmax())
    order = rng.permutation(n)
    for lo in range(0, n, BATCH):
        points = order[lo : lo + BATCH]
        found, _ = beam_search(x, graph, x[points], np.full(len(points), middle), beam, None if whole is None else whole[points])
        graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1).astype(np.int64), degree, alpha, whole)
        # backwards: group the new edges by their target
        src, dst = np.repeat(points, degree), graph[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, first, many = np.unique(dst, return_index=True, return_counts=True)
        most = min(int(many.max()), 3 * degree)
        for a in range(0, len(targets), BATCH):
            t, f, m = targets[a : a + BATCH], first[a : a + BATCH], many[a : a + BATCH]
            place = f[:, None] + np.arange(most)
            more = np.where(np.arange(most) < m[:, None], src[np.minimum(place, len(src) - 1)], -1)
            graph[t] = robust_prune(x, t, np.concatenate([graph[t], more], axis=1).astype(np.int64), degree, alpha, whole)
    return graph


def neighbours(
    x: np.ndarray, graph: np.ndarray, k: int, beam: int, asks: np.ndarray | None = None, whole: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """For each point, or each of the points ``asks``, its ``k`` most similar others found by a beam search
    from the point itself; missing places are -1."""
    asks = np.arange(len(x)) if asks is None else asks
    ids, sims = np.full((len(asks), k), -1, dtype=np.int64), np.full((len(asks), k), -np.inf, dtype=np.float32)
    for lo in range(0, len(asks), BATCH):
        points = asks[lo : lo + BATCH]
        got, s = beam_search(x, graph, x[points], points, beam, None if whole is None else whole[points])
        s = np.where((got == points[:, None]) | (got < 0), -np.inf, s)
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        take = np.arange(len(points))[:, None]
        m = top.shape[1]
        ids[lo : lo + len(points), :m], sims[lo : lo + len(points), :m] = got[take, top], s[take, top]
    return np.where(np.isfinite(sims), ids, -1), sims
