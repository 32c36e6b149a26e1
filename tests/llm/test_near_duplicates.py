"""The grouped prefix join and its components against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import near_duplicates
from paperloom.llm.near_duplicates import groups, similar_pairs, words_of
from paperloom.operators.components import connected_components
from paperloom.session import Workspace


def brute(rows, t):
    bags = [(i, Counter(words_of(x))) for i, x in rows]
    out = set()
    for i, a in bags:
        for j, b in bags:
            if i < j and a and b:
                c = (a & b).total()
                if c / (a.total() + b.total() - c) >= t:
                    out.add((i, j))
    return out


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    while len(rows) < n:
        words = rng.choices(vocabulary, weights, k=rng.choice([1, 2, 3, 5, 6, 7, 8, 12, 25, 40]))
        rows.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            edited = list(words)
            for _ in range(rng.randrange(1 + len(words) // 3)):
                k = rng.randrange(len(edited))
                edited[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [edited[k], rng.choice(vocabulary)]]) or edited[k : k + 1]
            rng.shuffle(edited)
            rows.append(", ".join(edited).upper())
    rows += [None, "", " .. ", rows[0], rows[0]]
    return [(f"c{i:04d}", x) for i, x in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("threshold", [0.7, 0.8])
@pytest.mark.parametrize("frequent", [2000, 20, 3])
def test_pairs_are_exact(spark, monkeypatch, seed, threshold, frequent):
    monkeypatch.setattr(near_duplicates, "FREQUENT_LEAST", frequent)
    rows = corpus(seed)
    got = similar_pairs(spark.createDataFrame(rows, "id string, text string"), "id", "text", threshold)
    assert {(r.id_a, r.id_b) for r in got.collect()} == brute([(i, x or "") for i, x in rows], threshold)


def test_large_inputs_meet_by_key(spark, monkeypatch):
    from paperloom.llm import common

    monkeypatch.setattr(common, "ENOUGH_BYTES", 0)
    rows = corpus(6, 80)
    got = similar_pairs(spark.createDataFrame(rows, "id string, text string").repartition(4), "id", "text", 0.7)
    assert {(r.id_a, r.id_b) for r in got.collect()} == brute([(i, x or "") for i, x in rows], 0.7)


def test_groups(spark):
    rows = corpus(4, 60)
    links = brute([(i, x or "") for i, x in rows], 0.7)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [(*rows[3], -1)], "id string, text string, member int")
    got = groups(df, "id", "text", 0.7).collect()
    assert {r.id: r.group_id for r in got} == {i: root(i) for i, _ in rows}
    assert len(got) == len(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], "id string, text string")
    assert similar_pairs(empty, "id", "text", 0.7).count() == 0
    assert groups(empty, "id", "text", 0.7).count() == 0
    long_ = " ".join(f"v{i % 700}" for i in range(3000))
    df = spark.createDataFrame([("a", long_), ("b", long_ + " x"), (None, long_), ("d", None)], "id string, text string")
    assert [(r.id_a, r.id_b) for r in similar_pairs(df, "id", "text", 0.7).collect()] == [("a", "b")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(1, None)]
    df = spark.createDataFrame(edges, "a int, b int")
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for hot in (200_000, 5):
        got = connected_components(df, "a", "b", Workspace(spark, "test"), hot).collect()
        assert {r.node: r.component for r in got} == {k: root(k) for k in parent}


@pytest.mark.parametrize("frequent", [40, 3])
@pytest.mark.parametrize("pair_most", [None, 1e9, 300.0, 0.0])
@pytest.mark.parametrize("square", [400, 7])
def test_lists_hold_all_pairs(monkeypatch, frequent, pair_most, square):
    """Keys of two and of three frequent words, compared pair by pair and in squares."""
    monkeypatch.setattr(near_duplicates, "SQUARE", square)
    texts = [x for seed in (3, 5) for _, x in corpus(seed, 250) if x and words_of(x)]
    word, n = near_duplicates.word_hashes(texts)
    word, _, nth = near_duplicates._occurrences(word, n)
    element, count = np.unique(near_duplicates._element(word[nth < near_duplicates.DEPTH], nth[nth < near_duplicates.DEPTH]), return_counts=True)
    mapper = near_duplicates._Mapper((element[count > frequent], count[count > frequent]), 0.7, pair_most)
    key, *rest = mapper.rows(texts)
    got = {frozenset((int(a), int(b))) for x, y in near_duplicates._compare(key.astype(np.uint32), *rest, 0.7) for a, b in zip(x, y)}
    member = near_duplicates.classes_of(*near_duplicates.word_hashes(texts)).tolist()
    true = {frozenset((member[i], member[j])) for i, j in brute(list(enumerate(texts)), 0.7) if member[i] != member[j]}
    assert len(true) > 100 and true <= got


def test_keys_of_common_words_are_not_hot():
    """Where all words are frequent, few records share a key, however many share two words."""
    rng = random.Random(8)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(60)], 40)) for _ in range(3000)]
    word, n = near_duplicates.word_hashes(texts)
    frequent = np.unique(near_duplicates._element(word, np.zeros(len(word), dtype=np.int64)), return_counts=True)
    key, *_ = near_duplicates._Mapper(frequent, 0.7, 0.01 * len(texts) ** 2).rows(texts)
    pairs, _, *_ = near_duplicates._Mapper(frequent, 0.7, None).rows(texts)
    assert np.unique(key, return_counts=True)[1].max() < 0.7 * np.unique(pairs, return_counts=True)[1].max()


def test_word_hashes_are_those_of_the_words():
    texts = ["", None, "Ab ab\nAB", "IL-6 and β-catenin", "\x00a b\x00", "ÀÉ 日本語 x_y", "a" * 8 + " " + "a" * 9 + " " + "a" * 16 + " " + "a" * 33, "İstanbul ǅ ½ ²", "...", "z"]
    word, n = near_duplicates.word_hashes(texts)
    split = [words_of(t) for t in texts]
    assert n.tolist() == [len(x) for x in split]
    flat = [w for x in split for w in x]
    assert len(set(zip(flat, word.tolist()))) == len(set(flat)) == len(set(word.tolist()))
