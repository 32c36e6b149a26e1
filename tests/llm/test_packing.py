"""Containers: nothing lost, nothing above capacity, few containers."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from paperloom.llm.packing import difference, fill, pack, pack_items


def test_difference_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 400)
    label, sums = difference(sizes, 7)
    assert (np.bincount(label, weights=sizes, minlength=7) == sums).all()
    assert sums.max() - sums.min() <= 2
    label, sums = difference(np.array([5, 5]), 4)
    assert sorted(sums) == [0, 0, 5, 5]


def test_pack_items_near_the_bound():
    rng = random.Random(3)
    for cap in (100, 977):
        sizes = np.array([rng.randrange(1, cap // 2) for _ in range(300)])
        label, sums = pack_items(sizes, cap)
        assert sums.max() <= cap and len(sums) <= -(-sizes.sum() // cap) + 2
    label, sums = pack_items(np.array([60, 60, 60]), 100)
    assert len(sums) == 3
    assert len(pack_items(np.array([], dtype=np.int64), 5)[1]) == 0


def test_frame(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 10, 40, 99, 100, 101, 250, 1000]), "z") for i in range(300)] + [(7, 10, "z"), (None, 30, "z"), (400, None, "z"), (401, 0, "z")]
    df = spark.createDataFrame(rows, "k int, size int, prompt string")
    packed = pack(df, "k", "size", {"small": 100, "big": 5000}, containers=20)
    got = packed.collect()
    for name, cap in (("small", 100), ("big", 5000)):
        mine = [r for r in got if r.cap_name == name]
        assert sum(r.n for r in mine) == sum(s or 0 for _, s, _ in rows)
        total = defaultdict(int)
        for r in mine:
            total[r.prompt] += r.n
        assert max(total.values()) <= cap
        pieces = defaultdict(list)
        for r in mine:
            pieces[r.k].append((r.start_at, r.n))
        for k, s, _ in rows:
            if s and k not in (7, None):
                assert len(pieces[k]) == (-(-s // cap) if s > cap else 1)
                assert sorted(pieces[k])[0][0] == 0 and sum(n for _, n in pieces[k]) == s
    report = {r.cap_name: r for r in fill(packed, {"small": 100, "big": 5000}).collect()}
    assert report["big"].fill > 0.9 and report["small"].fullest <= 100
    assert pack(df.limit(0), "k", "size", {"small": 100}).count() == 0


def test_copies_spread_over_shards(spark):
    """Equal rows, a third of all and more, fill no shard alone; each copy of a cut item has pieces of its own."""
    df = spark.createDataFrame([(None, 30)] * 2000 + [(5, 250)] * 60, "k int, size int")
    packed = pack(df, "k", "size", {"c": 100}, containers=10).collect()
    total, shards = defaultdict(int), defaultdict(int)
    for r in packed:
        total[r.prompt] += r.n
        shards[r.prompt.split("-")[0]] += r.k is None
    assert sum(total.values()) == 2000 * 30 + 60 * 250 and max(total.values()) <= 100
    assert len(shards) > 40 and max(shards.values()) < 200
