"""Calibration, normalisation and contrasts against plain arithmetic."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest

from paperloom.functions.student import t_cdf, t_quantile
from paperloom.operators import statistics as S


def test_student():
    # Known values of the distribution.
    assert t_quantile(0.975, 1) == pytest.approx(12.706204736, rel=1e-8)
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, rel=1e-8)
    assert t_quantile(0.995, 24) == pytest.approx(2.796939505, rel=1e-8)
    assert t_cdf(0, 5) == pytest.approx(0.5)


def test_calibration_and_normalise(spark):
    rows = [("t", "r", str(i), i == 0, 0.1 * i if i else 0.8) for i in range(10)] + [("u", "r", "0", True, 0.5), ("t", "r", "n", False, None)]
    band = S.calibration(spark.createDataFrame(rows, "task string, readout string, source string, is_self boolean, value double"))
    got = {r.task: r for r in band.collect()}
    peers = [0.1 * i for i in range(1, 10)]
    assert got["t"].q_lo == pytest.approx(np.quantile(peers, 0.1)) and got["t"].q_hi == pytest.approx(np.quantile(peers, 0.9))
    assert got["t"].peer_sd == pytest.approx(statistics.pstdev(peers)) and got["t"].n_peers == 9
    assert got["u"].q_lo is None and got["u"].peer_sd is None
    values = [("t", "r", "quality", "c", 0.5), ("t", "r", "style", "c", 0.5), ("t", "r", "style", "c", 2.0), ("t", "r", "quality", "c", None), ("t", "r", "quality", "task", 0.3), ("u", "r", "quality", "c", 0.25), ("v", "r", "style", "c", 0.25)]
    z = [(round(r.z, 6) if r.z is not None else None, r.z_note) for r in S.normalise(spark.createDataFrame(values, "task string, readout string, direction string, family string, value double"), band).orderBy("task", "direction", "family", "value").collect()]
    lo = np.quantile(peers, 0.1)
    assert (round((0.5 - lo) / (0.8 - lo), 6), "") in z and (1.0, "") in z and (0.0, "") in z
    assert (None, "bot") in z and (0.3, "pass_through") in z and (0.5, "no_peers") in z and (None, "no_calibration") in z


def plain(d, clusters, delta):
    n = len(d)
    mean = sum(d) / n
    groups = {}
    for x, c in zip(d, clusters):
        groups[c] = groups.get(c, 0) + x - mean
    k = len(groups)
    se = math.sqrt(k / (k - 1) * sum(v * v for v in groups.values())) / n
    return mean, se, t_quantile(1 - delta / 2, k - 1) * se


def test_contrasts(spark):
    rng = random.Random(1)
    rows = [(s, t, t % 4, rng.random() + (0.5 if s == "a" else 0)) for s in "abc" for t in range(12)] + [("d", t, t % 4, 1.0) for t in range(9)] + [("e", t, 0, 0.1) for t in range(12)] + [("b", 99, 1, None)]
    got = {(r.a, r.b): r for r in S.contrasts(spark.createDataFrame(rows, "system string, task int, cluster int, z double"), 0.05).collect()}
    z = {(s, t): v for s, t, _, v in rows}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        mean, se, q = plain([z[a, t] - z[b, t] for t in range(12)], [t % 4 for t in range(12)], 0.05)
        r = got[a, b]
        assert (r["diff"], r.se, r.q) == pytest.approx((mean, se, q)) and r.certified == (abs(mean) > q) and r.n == 12
    assert got["a", "d"].status == "too_few_tasks" and got["a", "d"].se is None
    # Singleton clusters give the ordinary standard error.
    lone = [(s, t, t, z[s, t]) for s in "ab" for t in range(12)]
    d = [z["a", t] - z["b", t] for t in range(12)]
    r = S.contrasts(spark.createDataFrame(lone, "system string, task int, cluster int, z double"), 0.05).first()
    assert r.se == pytest.approx(statistics.stdev(d) / math.sqrt(12))
    same = [(s, t, t, 0.5) for s in "ab" for t in range(12)]
    assert S.contrasts(spark.createDataFrame(same, "system string, task int, cluster int, z double"), 0.05).first().status == "tie_identical"


def test_composite(spark):
    rows = [("a", 1, "x", 1.0), ("a", 1, "y", 0.0), ("b", 1, "x", 0.25), ("b", 1, "y", 0.75), ("a", 2, "x", 1.0), ("b", 2, "y", 0.5), ("b", 2, "x", None)]
    got = {(r.system, r.task): (r.composite, r.agree) for r in S.composite(spark.createDataFrame(rows, "system string, task int, axis string, z double")).collect()}
    assert got == {("a", 1): (0.5, True), ("b", 1): (0.5, True), ("a", 2): (1.0, False), ("b", 2): (0.5, False)}
