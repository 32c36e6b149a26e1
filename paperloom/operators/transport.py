"""Fused distance of two labelled graphs: how well one can be laid over the other."""

from __future__ import annotations

import numpy as np

#: Nodes of a graph that its distance looks at, the first ones; part of the distance's definition.
MAX_NODES = 400
#: Weight of the edges against the nodes.
EDGE_WEIGHT = 0.5
#: Rounds, scaling steps in a round, and how far a round may move the plan (the smaller, the further).
ROUNDS, STEPS, STEP = 200, 20, 0.05


def node_costs(a: list, b: list) -> np.ndarray:
    """1 less the share of common members of all members of two sets, for each two; 1 if both are empty."""
    names = {x: i for i, x in enumerate({x for s in [*a, *b] for x in s})}
    rows = lambda sets: np.array([[float(n in s) for n in names] for s in map(set, sets)]).reshape(len(sets), len(names))
    x, y = rows(a), rows(b)
    common = x @ y.T
    either = x.sum(1)[:, None] + y.sum(1)[None, :] - common
    return 1 - common / np.maximum(either, 1)


def fused_distance(cost: np.ndarray, a: np.ndarray, b: np.ndarray, edge_weight: float = EDGE_WEIGHT) -> float:
    """Least found of (1 - w) x mean node cost + w x mean squared difference of edges, over plans of even mass.

    The plan starts even and moves against the gradient in steps that keep its mass, by scaling rows
    and columns; the problem has many local optima, of which the nearest is found, as by other solvers.
    """
    n, m = cost.shape
    p, q = np.full(n, 1 / n), np.full(m, 1 / m)
    const = (a**2 @ p)[:, None] + (b**2 @ q)[None, :]
    plan = np.outer(p, q)

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        edges = const - 2 * a @ t @ b.T
        return float((1 - edge_weight) * (cost * t).sum() + edge_weight * (edges * t).sum()), (1 - edge_weight) * cost + 2 * edge_weight * edges

    best, grad = value(plan)
    for _ in range(ROUNDS):
        kernel = plan * np.exp(-(grad - grad.min()) / STEP)
        kernel = np.maximum(kernel, 1e-300)
        u, v = np.ones(n), np.ones(m)
        for _ in range(STEPS):
            u = p / (kernel @ v)
            v = q / (u @ kernel)
        plan = u[:, None] * kernel * v[None, :]
        now, grad = value(plan)
        if abs(best - now) < 1e-9:
            best = min(best, now)
            break
        best = min(best, now)
    return min(1.0, max(0.0, best))


def graph_distance(nodes_a, edges_a, nodes_b, edges_b) -> float | None:
    """Distance of two graphs given as node structs (with ``pmids``) and edges of 1-based places; null if either is empty."""
    if nodes_a is None or nodes_b is None or not len(nodes_a) or not len(nodes_b):
        return None

    def matrix(n: int, edges) -> np.ndarray:
        out = np.zeros((n, n))
        for e in edges if edges is not None else ():
            out[e["x"] - 1, e["y"] - 1] = out[e["y"] - 1, e["x"] - 1] = 1.0
        return out

    cost = node_costs([x["pmids"] for x in nodes_a], [x["pmids"] for x in nodes_b])
    return round(fused_distance(cost, matrix(len(nodes_a), edges_a), matrix(len(nodes_b), edges_b)), 6)
