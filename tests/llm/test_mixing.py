"""Shares, caps on repeats and the order of a mix."""

from __future__ import annotations

import random

import pytest

from paperloom.llm import mixing
from paperloom.llm.mixing import Target, budgets, mix, shares

TARGETS = [Target("a", 0.5, 1), Target("b", 0.3, 3), Target("c", 0.15, 2), Target("none", 0.05, 2)]


def test_budgets():
    got = budgets(TARGETS, {"a": 1000, "b": 300, "c": 400})
    assert got["none"] == 0 and got["a"] / sum(got.values()) == pytest.approx(0.5 / 0.95)
    assert got["b"] <= 900
    short = budgets(TARGETS, {"a": 1000, "b": 10, "c": 400})
    assert short["b"] == 30 and sum(short.values()) >= 0.5 * 1410 - 1e-6
    assert budgets(TARGETS, {}) == {t.source: 0.0 for t in TARGETS}
    fixed = budgets(TARGETS, {"a": 1000, "b": 300, "c": 400}, total=500)
    assert sum(fixed.values()) == pytest.approx(500)


@pytest.mark.parametrize("bucket", [50_000, 20])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = random.Random(1)
    rows = [(i, rng.choice("aaaabbc"), rng.randrange(1, 60)) for i in range(600)] + [(1000, None, 5), (1001, "a", None), (1002, "x", 9), (1003, "b", 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, source string, n int, slot int")
    got = mix(df, "id", "source", "n", TARGETS).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got)))
    assert len({(r.id, r.use) for r in got}) == len(got)
    assert all(r.use <= next(t.repeats for t in TARGETS if t.source == r.source) for r in got)
    assert not {r.id for r in got} & {1000, 1001, 1002, 1003}
    total = sum(r.n_tokens for r in got)
    share = {s: sum(r.n_tokens for r in got if r.source == s) / total for s in "abc"}
    assert share["a"] == pytest.approx(0.5 / 0.95, abs=0.01) and share["c"] == pytest.approx(0.15 / 0.95, abs=0.01)
    # At any time every source is within about a document of its part.
    done = dict.fromkeys("abc", 0)
    for r in got:
        done[r.source] += r.n_tokens
        at = sum(done.values())
        assert all(abs(done[s] - share[s] * at) <= 2 * 60 + 0.01 * at for s in "abc")
    report = {r.source: r for r in shares(mix(df, "id", "source", "n", TARGETS), TARGETS).collect()}
    assert report["none"].n_tokens == 0 and report["a"].max_use == 1


def test_empty(spark):
    df = spark.createDataFrame([], "id int, source string, n int")
    assert mix(df, "id", "source", "n", TARGETS).count() == 0
    assert {r.source: r.actual_share for r in shares(mix(df, "id", "source", "n", TARGETS), TARGETS).collect()} == {t.source: 0.0 for t in TARGETS}
