"""Sequences against each other: alignment, relocation, optimal transport on small state spaces."""

from __future__ import annotations

import hashlib

import numpy as np


def align(a: list, b: list, gap: float = -1.0, same: float = 2.0, near: float = 1.0, other: float = -1.0) -> float:
    """Score of the best global alignment; items may be pairs, of which equal first parts are near."""
    row = np.arange(len(b) + 1) * gap
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i * gap
        for j, y in enumerate(b, 1):
            s = same if x == y else near if isinstance(x, tuple) and isinstance(y, tuple) and x[0] == y[0] else other
            new[j] = max(row[j - 1] + s, row[j] + gap, new[j - 1] + gap)
        row = new
    return float(row[-1])


def relocate(text: str, start: int, size: int, digest: str) -> tuple[int | None, str]:
    """(where, how) a span of known digest stands in a text that may have changed.

    exact: at its old place; moved: at the nearest other place; lost: nowhere.
    """
    hit = lambda i: 0 <= i <= len(text) - size and hashlib.sha256(text[i : i + size].encode()).hexdigest() == digest
    if hit(start):
        return start, "exact"
    for d in range(1, len(text) + 1):
        for i in (start - d, start + d):
            if hit(i):
                return i, "moved"
    return None, "lost"


def transport(p: np.ndarray, q: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving the distribution p to q, by successive shortest paths; for few states."""
    supply, demand = p.astype(float).copy(), q.astype(float).copy()
    n, m = cost.shape
    flow = np.zeros((n, m))
    total = 0.0
    while supply.sum() > 1e-12:
        # Shortest path from any supply to any demand over the residual network (Bellman-Ford).
        dist = np.r_[np.where(supply > 1e-15, 0.0, np.inf), np.full(m, np.inf)]
        back = np.full(n + m, -1)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                if dist[i] < np.inf:
                    better = dist[i] + cost[i] < dist[n:] - 1e-15
                    if better.any():
                        dist[n:][better], back[n:][better], changed = (dist[i] + cost[i])[better], i, True
            for j in range(m):
                if dist[n + j] < np.inf:
                    way = np.where(flow[:, j] > 1e-15, dist[n + j] - cost[:, j], np.inf)
                    better = way < dist[:n] - 1e-15
                    if better.any():
                        dist[:n][better], back[:n][better], changed = way[better], n + j, True
            if not changed:
                break
        end = int(np.argmin(np.where(demand > 1e-15, dist[n:], np.inf)))
        path, at = [], n + end
        while back[at] >= 0:
            path.append((back[at], at))
            at = int(back[at])
        push = min(supply[at], demand[end], *[flow[v, u - n] for u, v in path if u >= n] or [np.inf])
        for u, v in path:
            if u < n:
                flow[u, v - n] += push
                total += push * cost[u, v - n]
            else:
                flow[v, u - n] -= push
                total -= push * cost[v, u - n]
        supply[at] -= push
        demand[end] -= push
    return total


def fixed_point(p: np.ndarray, q: np.ndarray, labels: np.ndarray, discount: float = 0.9, weight: float = 0.5, tolerance: float = 1e-6, rounds: int = 500) -> tuple[np.ndarray, int]:
    """(distance of states, rounds): the fixed point of mixing label distance with transported distance.

    ``p``, ``q``: transition matrices over the same states; ``labels``: distance of what states show.  The map
    contracts by ``discount`` x (1 - ``weight``), so the rounds are bounded by the tolerance.
    """
    d = np.zeros_like(labels, dtype=float)
    for r in range(1, rounds + 1):
        moved = np.array([[transport(p[i], q[j], d) for j in range(len(q))] for i in range(len(p))])
        new = weight * labels + (1 - weight) * discount * moved
        gap = float(np.abs(new - d).max())
        d = new
        if gap < tolerance:
            break
    return d, r
