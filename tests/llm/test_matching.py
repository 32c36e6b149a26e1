"""Record matching: scoring, windows and assignment."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from paperloom.llm import matching
from paperloom.llm.bibliography import Record, confidence, doi_of, surnames_of, year_of
from paperloom.llm.matching import _best_assignment, assign, match_records
from paperloom.session import Workspace

P = ("Lipid droplet turnover in hepatocytes: the RAC12 pathway", "10.1234/abcd.2020.1", '["Ada B. Krumell", "Ole Vintar"]', "2020-03-01")
SAME = [
    ("lipid droplet turnovr in hepatocytes: the RAC12 pathway (Article)", "", "Krumell AB; Vintar O", "2020"),
    ("Lipid droplet turnover in hepatocytes: the RAC12 pathway: a preprint", "10.99/pre.1", "A. B. Krumell et al.", "Dec 2019"),
    ("LIPID DROPLET TURNOVER IN HEPATOCYTES: THE RAC12 PATHWAY", "https://doi.org/10.1234/ABCD.2020.1", None, None),
]
OTHER = [
    ("Erratum: Lipid droplet turnover in hepatocytes: the RAC12 pathway", "", "Krumell AB; Vintar O", "2020"),
    ("Lipid droplet turnover in hepatocytes: the RAC12 pathway, part 2", "", "Krumell AB; Vintar O", "2020"),
    ("Lipid droplet turnover in hepatocytes: the RAC12 pathway", "", "Zorn F; Pell G", "2011"),
    ("Quorum sensing of MUV3 in soil bacteria after heat shock", "", "Krumell AB; Vintar O", "2020"),
    (None, "10.1234/abcd.2020.1", "Krumell AB", "2020"),
    ("", "", "", ""),
]


def test_scores():
    for other in SAME:
        assert confidence(Record(*P), Record(*other)) > 0.5, other
    for other in OTHER:
        assert confidence(Record(*P), Record(*other)) < 0.5, other


def test_fields():
    assert doi_of("DOI 10.1234%2FAb.9.") == "10.1234/ab.9"
    assert year_of("3 Mar 1999") == 1999 and year_of("n.d.") is None
    for text in ('["Zoë A. Nörd", "Ty van Bel"]', "Nörd, Zoë A | Bel, Ty", "Z. A. Nörd and T. Bel", "Nörd ZA & Bel T", "Zoë Nörd, Ty Bel"):
        assert surnames_of(text) == ["nord", "bel"], text
    assert surnames_of("NÖRD, ZOË") == ["nord"] and surnames_of(None) == [] and surnames_of("[broken") == []


def _optimum(w):
    """Greatest sum of a one-to-one choice of cells, by trying all."""
    n, m = w.shape
    w = w if n <= m else w.T
    return max(sum(w[i, j] for i, j in enumerate(c)) for c in itertools.permutations(range(w.shape[1]), w.shape[0]))


def test_auction_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        for w in (rng.random((n, m)), np.full((n, m), 0.5), np.round(rng.random((n, m)), 1) + 0.1):
            a, b = (x.ravel() for x in np.indices((n, m)))
            kept = _best_assignment(a, b, w.ravel())
            assert len(set(a[kept])) == len(set(b[kept])) == len(kept)
            assert w.ravel()[kept].sum() >= _optimum(w) - min(n, m) * matching.INCREMENT


@pytest.mark.parametrize("in_task", [400, 5])
def test_assign(spark, monkeypatch, in_task):
    """The optimum is reached within a task, and by bidders spread over several."""
    monkeypatch.setattr(matching, "TASK_EDGES", in_task)
    rng = random.Random(2)
    edges = [(i, 100 + j, round(rng.random(), 6)) for i in range(6) for j in range(6) if rng.random() < 0.6] + [(50, 150, 0.9)]
    got = [tuple(r) for r in assign(spark.createDataFrame(edges, "a long, b long, confidence double"), Workspace(spark, "test")).collect()]
    assert len({a for a, _, _ in got}) == len(got) == len({b for _, b, _ in got}) and (50, 150, 0.9) in got
    w = np.zeros((6, 6))
    for a, b, c in edges[:-1]:
        w[a, b - 100] = c
    assert sum(c for a, _, c in got if a != 50) >= _optimum(w) - 6 * matching.INCREMENT


@pytest.mark.parametrize("in_task", [10_000, 150])
def test_assign_equal_confidences(spark, monkeypatch, in_task):
    """One title of all records, each of which met its neighbours in the order: all but a few get one."""
    monkeypatch.setattr(matching, "TASK_EDGES", in_task)
    rng = random.Random(4)
    n = 400
    edges = {(i, min(n - 1, max(0, i + rng.randint(-6, 6)))) for i in range(n) for _ in range(5)}
    got = assign(spark.createDataFrame([(a, 1000 + b, 0.8) for a, b in edges], "a long, b long, confidence double"), Workspace(spark, "test")).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got) >= 0.98 * n


@pytest.mark.parametrize("in_task", [10_000, 100])
def test_assign_one_large_component(spark, monkeypatch, in_task):
    """A chain in which each best edge taken first would give up two that are better together."""
    monkeypatch.setattr(matching, "TASK_EDGES", in_task)
    n = 300
    edges = [(i, 1000 + i, 0.8) for i in range(n)] + [(i + 1, 1000 + i, 0.1 if i % 2 else 0.9) for i in range(n - 1)]
    got = assign(spark.createDataFrame(edges, "a long, b long, confidence double"), Workspace(spark, "test")).collect()
    assert {(r.a, r.b) for r in got} == {(i, 1000 + i) for i in range(n)}


def test_match_records(spark):
    schema = "id long, title string, doi string, authors string, date string, src string"
    papers = spark.createDataFrame([(1, *P, "x"), (2, "Corrigendum: " + P[0], None, P[2], P[3], "x"), (3, None, None, None, None, None), (None, *P, "x")], schema)
    listings = spark.createDataFrame([(10 + i, *r, "y") for i, r in enumerate(SAME + OTHER)], schema)
    got = match_records(papers, listings)
    assert {(r.paper, r.listing) for r in got.collect()} == {(1, 10), (1, 11), (1, 12)}
    assert match_records(papers.limit(0), listings).count() == 0
    assert match_records(papers.limit(0), listings.limit(0)).count() == 0


def test_windows_cross_partitions(spark, monkeypatch):
    """With a hot title and many partitions, every neighbour within the window is met."""
    rng = random.Random(9)
    names = ["".join(rng.choice("bcdfghklmnprstvwzaeiou") for _ in range(10)) for _ in range(120)]
    rows = [(i, f"{'shared title of all works' if i % 3 else 'other work'} on g{i:03d}x", None, f"{names[i].capitalize()} A", "2000") for i in range(120)]
    schema = "id long, title string, doi string, authors string, date string"
    papers = spark.createDataFrame(rows, schema)
    got = match_records(papers, papers)
    assert {(r.paper, r.listing) for r in got.collect()} == {(i, i) for i in range(120)}


@pytest.mark.parametrize("n", [40, 400])
def test_long_common_openings(spark, n):
    """Titles that differ only after a long opening still meet, however many share it."""
    rng = random.Random(5)
    code = lambda: "".join(rng.choice("bcdfghklmnprstvwz") for _ in range(7))
    rows = [(i, f"Pharmacological characterization of {code()} {code()} {code()} {code()}", None, None, None) for i in range(n)]
    schema = "id long, title string, doi string, authors string, date string"
    got = match_records(spark.createDataFrame(rows, schema), spark.createDataFrame(rng.sample(rows, n), schema))
    assert {(r.paper, r.listing) for r in got.collect()} == {(i, i) for i in range(n)}


def test_equal_keys_are_ordered_by_content_and_mix_sources(spark):
    """Papers and listings of one title: names order them; where all is equal, the sources mix."""
    for names in (lambda i: f"Sur{i:03d}", lambda i: None):
        rows = [(src, i, *matching._sketch(r), r.sort_keys()) for src in (0, 1) for i in range(40) for r in [Record("Annual report", None, names(i), None)]]
        df = spark.createDataFrame(rows, "src int, id long, s1 long, s2 long, marks long, keys array<string>")
        pairs = {(r.a, r.b) for r in matching.window_pairs(df, 1, Workspace(spark, "test")).where("a_src = 0 and b_src = 1").collect()}
        if names(0):
            assert pairs >= {(i, i) for i in range(40)}
        else:
            assert len(pairs) >= 10
