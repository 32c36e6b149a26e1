"""Hierarchies against a plain walk, and their defined edge cases."""

from __future__ import annotations

import random

import pytest

from paperloom.operators.hierarchy import descendants, resolve, with_descendant_counts
from paperloom.operators.skew import hot_keys, lookup_join

SCHEMA = "tree string, id string, parent string"


def walk(rows):
    """kind, root, depth, path of each node by following parents one by one."""
    up = {}
    for t, i, p in rows:
        if i is not None:
            old = up.get((t, i))
            new = p or None
            up[t, i] = new if (t, i) not in up else min([x for x in (old, new) if x], default=None)
    out = {}
    for t, i in up:
        path, at, seen = [], i, set()
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            nxt = up[t, at]
            at = nxt if nxt is not None and (t, nxt) in up else None
        if at is None:
            lost = up[t, i] is not None and (t, up[t, i]) not in up
            out[t, i] = ("missing_parent" if lost else "sound", path[-1], len(path) - 1, path[::-1])
        else:
            steps, on = up[t, i], False
            for _ in range(len(up) + 1):
                if steps == i:
                    on = True
                    break
                steps = up[t, steps]
            out[t, i] = ("on_cycle" if on else "below_cycle", None, None, None)
    return out


def forest(seed):
    rng = random.Random(seed)
    rows = []
    for t in ("a", "b", None):
        n = rng.choice([1, 5, 40])
        for k in range(n):
            p = rng.choice([None, "", f"n{rng.randrange(n)}", f"n{max(0, k - 1)}", f"n{max(0, k - 1)}", "gone"])
            rows.append((t, f"n{k}", p))
    rows += [("deep", f"d{k}", f"d{k - 1}" if k else None) for k in range(70)]
    rows += [("ring", f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("ring", f"s{k}", f"s{k + 1}" if k < 20 else "r3") for k in range(21)]
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [200_000, 3])
def test_against_walk(spark, seed, hot_rows):
    rows = forest(seed)
    got = resolve(spark.createDataFrame(rows, SCHEMA), ["tree"], hot_rows=hot_rows).collect()
    assert {(r["tree"], r["id"]): (r["kind"], r["root"], r["depth"], r["path"]) for r in got} == walk(rows)
    assert len(got) == len({(r["tree"], r["id"]) for r in got})


def test_descendants_and_counts(spark):
    df = spark.createDataFrame([("t", "a", None), ("t", "b", "a"), ("t", "c", "b"), ("t", "x", "x")], SCHEMA)
    nodes = resolve(df, ["tree"])
    assert {(r.ancestor, r.id, r.distance) for r in descendants(nodes, ["tree"]).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {r.id: r.n_descendants for r in with_descendant_counts(nodes, ["tree"]).collect()} == {"a": 2, "b": 1, "c": 0, "x": None}


def test_edges(spark):
    assert resolve(spark.createDataFrame([], SCHEMA), ["tree"]).count() == 0
    clash = spark.createDataFrame([("t", "a", None, 1, "x"), ("t", None, "a", 2, "y")], "tree string, id string, parent string, depth int, path string")
    assert [(r.id, r.kind, r.depth) for r in resolve(clash, ["tree"]).collect()] == [("a", "sound", 0)]


def test_lookup_join_splits_hot_keys(spark):
    many = spark.createDataFrame([("h", i) for i in range(60)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    one = spark.createDataFrame([("h", "H"), ("k1", "A")], "k string, w string")
    assert [r.k for r in hot_keys(many, ["k"], 100, 10).collect()] == ["h"]
    plain = {tuple(r) for r in many.join(one, "k", "left").collect()}
    assert {tuple(r) for r in lookup_join(many, one, ["k"], 100, "left", 10).collect()} == plain
