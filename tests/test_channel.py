"""Cosines of texts against brute force, and greedy matching within groups."""

from __future__ import annotations

import random
from collections import Counter
from math import sqrt

import pytest

from paperloom.operators import assignment
from paperloom.operators.assignment import one_to_one
from paperloom.operators.cosine import best_cosines, cosine_cells, cosine_join
from paperloom.session import Workspace

SCHEMA = "g string, {} string, tokens array<string>, cosine string"


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["of", "cell", "cell", "gene", "rate"] + [f"w{i}" for i in range(25)]
    rows = [(rng.choice(["p", "p", "q"]), f"{i:03d}", rng.choices(words, k=rng.randint(0, 9)), "clash") for i in range(n)]
    return rows + [("p", "n0", None, None), (None, "n1", ["cell"], None), ("q", "e0", [], None)]


def _cosine(x, y):
    p, q = Counter(x), Counter(y)
    return round(sum(n * q[t] for t, n in p.items()) / sqrt(sum(n * n for n in p.values()) * sum(n * n for n in q.values())), 6)


@pytest.mark.parametrize("least", [0.0, 0.6, 0.9, 1.0])
def test_cosines_equal_brute_force(spark, least):
    """Null groups and null or empty texts have no cosine; extra columns are not read."""
    a, b = _texts(1, 60), _texts(2, 60)
    want = {(g, i, j): c for g, i, x, _ in a for h, j, y, _ in b if g and g == h and x and y and (c := _cosine(x, y)) > 0 and c >= least}
    da, db = spark.createDataFrame(a, SCHEMA.format("a")), spark.createDataFrame(b, SCHEMA.format("b"))
    got = cosine_cells(da, db, ["g"]) if not least else cosine_join(da, db, ["g"], least)
    rows = got.collect()
    assert {(r.g, r.a, r.b): r.cosine for r in rows} == want and len(rows) == len(want)
    assert cosine_cells(da.limit(0), db, ["g"]).count() == cosine_join(da, db.limit(0), ["g"], 0.5).count() == 0


def test_best_cosines(spark):
    sets = {"p": [["cell", "gene"], ["rate"]], "q": []}
    rows = [("1", "p", ["gene", "cell"]), ("2", "p", ["other"]), ("3", "p", None), ("4", "q", ["cell"]), ("5", "r", ["cell"]), ("6", "p", ["rate", "cell"])]
    got = best_cosines(spark.createDataFrame(rows, "k string, s string, tokens array<string>"), "k", "s", sets)
    assert {r.k: r.best for r in got.collect()} == {"1": 1.0, "2": 0.0, "3": 0.0, "4": 0.0, "6": round(1 / sqrt(2), 6)}


@pytest.mark.parametrize("in_task", [100_000, 3])
def test_one_to_one_takes_in_order(spark, monkeypatch, in_task):
    """The same edges are taken within a task and in rounds, ties by both names."""
    monkeypatch.setattr(assignment, "GROUP_EDGES", in_task)
    rng = random.Random(3)
    edges = list({(g, f"a{rng.randrange(8)}", f"b{rng.randrange(8)}"): round(rng.random(), 1) for g in "xy" for _ in range(40)}.items())
    rows = [(*k, s, 7) for k, s in edges]
    want = set()
    for g, a, b, s, _ in sorted(rows, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if not any(g == h and (a == p or b == q) for h, p, q in want):
            want.add((g, a, b))
    df = spark.createDataFrame(rows, "g string, a string, b string, score double, _x int")
    order = [("score", True), ("a", True), ("b", True)]
    got = one_to_one(df, ["g"], "a", "b", order, Workspace(spark, "test")).collect()
    assert {(r.g, r.a, r.b) for r in got} == want and len(got) == len(want)
    assert one_to_one(df.limit(0), ["g"], "a", "b", order, Workspace(spark, "test")).count() == 0


def test_j09_moves_no_row_per_candidate(spark, monkeypatch):
    """300 claims and 300 sentences of one task, all alike but not near: candidates must not be shuffled."""
    from paperloom.plans import channel

    rows = [(f"c{i:03}", "t", f"gene cell lung c{i} d{i} e{i} f{i} g{i}", 0.5) for i in range(300)] + [(f"s{i:03}", "t", f"gene cell lung k{i} l{i} m{i} n{i} o{i}", None) for i in range(300)]
    rows += [("c900", "t", "Gene  cell lung k7 l7 m7 n7 o7", 0.1), ("c901", "t", "gene cell lung k7 l7 m7 n7 p7", 0.1), ("s900", "t", "gene cell lung k7 l7 m7 n7 o7", None)]
    claims = spark.createDataFrame(rows, "id string, task string, text string, groundedness double")
    monkeypatch.setattr(channel.D, "claims", lambda *_: claims)
    monkeypatch.setattr(channel, "table", lambda *_: claims)
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList

    def moved():
        stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = moved()
    got = {r.id: (r.sentence, r.cosine, r.kind) for r in channel.j09_channel(spark, "").collect()}
    assert got == {"c900": ("s007", 1.0, "exact"), "c901": ("s007", 0.875, "near")}
    assert moved() - before < 2000


def test_sayings_of_large_groups(spark):
    """A group of more than one block gives the same matches as a small one."""
    from pyspark.sql import functions as F

    from paperloom.operators.cosine import BLOCK, sayings

    rows = [("t", f"s{i:02}", True, f"w{i} x{i} y{i} z{i}") for i in range(60)] + [("t", f"c{i:02}", False, f"w{i} x{i} y{i} {'z' if i % 2 else 'q'}{i}") for i in range(60)]
    texts = spark.createDataFrame(rows, "task string, id string, said boolean, norm string")
    sizes = spark.createDataFrame([("t", 1)], "task string, n long")
    one, many = (sorted(map(tuple, sayings(texts, "task", sizes.withColumn("n", F.lit(n).cast("long")), 0.7).collect())) for n in (1, 5 * BLOCK))
    assert one == many == sorted(("t", f"c{i:02}", f"s{i:02}", 1.0 if i % 2 else 0.75, "exact" if i % 2 else "near") for i in range(60))
