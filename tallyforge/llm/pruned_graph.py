"""Robust-pruned neighbour graphs of bounded sets of directions, and range-expanding search."""

from __future__ import annotations

import numpy as np

#: Nearest and drawn rows that pruning chooses from, edges it keeps, edges with reverse ones.
NEAREST, DRAWN, DEGREE, MOST_EDGES = 64, 24, 20, 40
#: An edge goes where a kept neighbour is this much closer to its end than the row is.
ALPHA = 1.2
#: Search list, links at which a search counts as full, rows expanded at once, queries at once.
WIDTH, FULL, EXPAND, TOGETHER = 24, 64, 4, 512
MEDOIDS = 16


def robust_prune(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directed edges (from, to) of the rows of a symmetric matrix of cosines: for each row the
    nearest candidate is kept and those it dominates go, until DEGREE are kept; reverse edges
    are added and each row keeps its MOST_EDGES closest."""
    n = len(sims)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rng = np.random.default_rng(n)
    wide = min(NEAREST, n - 1)
    ends, begins = [], []
    for low in range(0, n, TOGETHER):
        rows = np.arange(low, min(n, low + TOGETHER))
        own = sims[rows].copy()
        own[np.arange(len(rows)), rows] = -np.inf
        pick = np.concatenate([np.argpartition(-own, wide - 1, axis=1)[:, :wide], rng.integers(0, n, (len(rows), DRAWN))], axis=1)
        near = np.take_along_axis(own, pick, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        pick, near = np.take_along_axis(pick, order, axis=1), np.take_along_axis(near, order, axis=1)
        far = np.sqrt(np.maximum(0, 2 - 2 * near))
        alive = pick != rows[:, None]
        for _ in range(DEGREE):
            at = alive.argmax(axis=1)
            live = np.flatnonzero(alive[np.arange(len(rows)), at])
            if not len(live):
                break
            kept = pick[live, at[live]]
            begins.append(rows[live])
            ends.append(kept)
            between = np.sqrt(np.maximum(0, 2 - 2 * sims[kept[:, None], pick[live]]))
            gone = (ALPHA * between <= far[live]) | (pick[live] == kept[:, None])
            alive[live] &= ~gone
    a, b = np.concatenate(begins), np.concatenate(ends)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    order = np.lexsort((b, -sims[a, b], a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < MOST_EDGES], b[rank < MOST_EDGES]


def medoids(x: np.ndarray) -> np.ndarray:
    """The row closest to the mean, then rows far from those chosen so far."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.unique(chosen)


def padded(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges, sorted by a, as one row of ends for each of n rows, filled up with -1."""
    count = np.bincount(a, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1, dtype=np.int64)
    out[a, np.arange(len(a)) - (np.cumsum(count) - count)[a]] = b
    return out


def range_search(x: np.ndarray, edges: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, full): rows with a cosine of about ``least`` or more to each row of x.

    A greedy search over ``edges`` starts from medoids and the row itself, keeps a list of the
    WIDTH best, and goes on from every row within range. A query with FULL rows in range stops:
    it is marked full and its rows aren't to be relied on."""
    n, entry = len(x), medoids(x)
    hold = WIDTH + FULL
    full = np.zeros(n, dtype=bool)
    queries, found = [], []
    for low in range(0, n, TOGETHER):
        rows = np.arange(low, min(n, low + TOGETHER))
        seen = np.full((len(rows), n), -1, dtype=np.int16)
        ids, vals = np.zeros((len(rows), hold), dtype=np.int64), np.full((len(rows), hold), -np.inf, dtype=np.float32)
        done = np.ones((len(rows), hold), dtype=bool)
        active = np.arange(len(rows))
        fresh = np.concatenate([np.tile(entry, (len(rows), 1)), rows[:, None]], axis=1)
        while len(active):
            # of rows met more than once in this step, and rows met before, none counts again
            new = (fresh >= 0) & (seen[active[:, None], fresh] < 0)
            r, c = np.nonzero(new)
            seen[active[r], fresh[r, c]] = c
            new[r, c] = seen[active[r], fresh[r, c]] == c
            r, c = np.nonzero(new)
            sims = np.full(fresh.shape, -np.inf, dtype=np.float32)
            sims[r, c] = np.einsum("kd,kd->k", x[rows[active[r]]], x[fresh[r, c]])
            v = np.concatenate([vals[active], sims], axis=1)
            order = np.argsort(-v, axis=1, kind="stable")[:, :hold]
            take = lambda m: np.take_along_axis(m, order, axis=1)
            vals[active], ids[active] = take(v), take(np.concatenate([ids[active], fresh], axis=1))
            done[active] = take(np.concatenate([done[active], ~new], axis=1))
            # the row itself is in its list, so one more than FULL
            full[rows[active]] = (vals[active] >= least).sum(axis=1) > FULL
            best = ~done[active] & ((np.arange(hold) < WIDTH) | (vals[active] >= least))
            best &= best.cumsum(axis=1) <= EXPAND
            on = best.any(axis=1) & ~full[rows[active]]
            active, best = active[on], best[on]
            r, c = np.nonzero(best)
            turn = np.arange(len(r)) - np.searchsorted(r, r)
            done[active[r], c] = True
            step = np.full((len(active), EXPAND, edges.shape[1]), -1, dtype=np.int64)
            step[r, turn] = edges[ids[active[r], c]]
            fresh = step.reshape(len(active), EXPAND * edges.shape[1])
        r, c = np.nonzero((vals >= least) & ~full[rows][:, None])
        queries.append(rows[r])
        found.append(ids[r, c])
    q, y = np.concatenate(queries), np.concatenate(found)
    return q[q != y], y[q != y], full
