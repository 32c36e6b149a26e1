"""Alignment, relocation and transport on cases that can be checked by hand."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from paperloom.operators.alignment import align, fixed_point, relocate, transport


def test_align():
    assert align(list("abc"), list("abc")) == 6
    assert align(list("abc"), list("ac")) == 3
    assert align([], list("ab")) == -2
    assert align([("s", 1)], [("s", 2)]) == 1


def test_relocate():
    text = "one two three four"
    h = hashlib.sha256(b"three").hexdigest()
    assert relocate(text, 8, 5, h) == (8, "exact")
    assert relocate("xx " + text, 8, 5, h) == (11, "moved")
    assert relocate("nothing", 8, 5, h) == (None, "lost")
    assert relocate("", 0, 5, h) == (None, "lost")


def test_transport_on_a_line():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 7))
        p, q = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n))
        cost = np.abs(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
        assert transport(p, q, cost) == pytest.approx(np.abs(np.cumsum(p - q))[:-1].sum(), abs=1e-9)
    assert transport(np.array([1.0]), np.array([1.0]), np.zeros((1, 1))) == 0


def test_fixed_point():
    p = np.array([[0.5, 0.5], [0.2, 0.8]])
    labels = 1.0 - np.eye(2)
    d, rounds = fixed_point(p, p, labels)
    assert rounds < 60 and d[0, 0] == pytest.approx(0, abs=1e-9) and d[1, 1] == pytest.approx(0, abs=1e-9)
    # d(0,1) = w + (1 - w) g * 0.3 d(0,1), as 0.3 of the mass has to move.
    assert d[0, 1] == pytest.approx(0.5 / (1 - 0.5 * 0.9 * 0.3), abs=1e-5)
