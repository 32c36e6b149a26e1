"""Roles, drafts, owners, references and call matches on fixtures; distances of small graphs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import drafts as W
from paperloom.operators.transport import fused_distance, graph_distance, node_costs

SIGNS = [("outline", "(?i)outline"), ("section", "(?i)section")]


def test_roles(spark):
    rows = [(1, "Write the outline."), (2, "Outline of a section"), (3, "hello"), (4, None), (5, ""), (6, "HEAD x TAIL\n"), (7, "HEAD x")]
    df = spark.createDataFrame(rows, "i int, p string")
    got = df.select("i", W.role_of(F.col("p"), SIGNS).alias("a"), W.role_of(F.col("p"), SIGNS, "only").alias("b"), W.role_by_ends(F.col("p"), [("ends", "HEAD", "TAIL")]).alias("c")).collect()
    assert [r.a for r in got] == ["outline", "outline", "other", "other", "other", "other", "other"]
    assert [r.b for r in got] == ["outline", "ambiguous", "unmatched", "unmatched", "unmatched", "unmatched", "unmatched"]
    assert [r.c for r in got] == ["other"] * 5 + ["ends", "other"]


def test_drafts_keep_first_or_last(spark):
    rows = [("r", "a", 1, "x", 0), ("r", "a", 2, "y", 0), ("r", "b", 1, None, 0), ("r", None, 3, "z", 0), ("r", "a", 2, "y", 0)]
    df = spark.createDataFrame(rows, "run string, target string, seq int, text string, calls_ int")
    for pick, text in (("first", "x"), ("last", "y")):
        got = {r.target: (r.text, r.calls) for r in W.drafts(df, ["run", "target"], ["seq", "text"], pick).collect()}
        assert got == {"a": (text, 3), "b": (None, 1), None: ("z", 1)}
    assert W.drafts(df.limit(0), ["run"], ["seq"]).count() == 0
    flags = spark.createDataFrame([("a", None), ("  \n", None), (None, None), ("a", "timeout")], "c string, e string")
    assert [r[0] for r in flags.select(W.usable(F.col("c"), F.col("e"))).collect()] == [True, False, False, False]


def test_outline_tree(spark):
    lines = ["# T", "text", "## A", "### A1", "### A2", "## B", "### B1", "#### B11"]
    df = spark.createDataFrame([(1, lines), (2, []), (3, None)], "d int, lines array<string>")
    level = F.nullif(F.length(F.regexp_extract("line", "^(#+) ", 1)), F.lit(0))
    got = [(r.k, r.level, r.title, r.parent, r.leaf) for r in W.outline_tree(df, "d", "lines", level, F.regexp_replace("line", "^#+ ", "")).orderBy("k").collect()]
    assert got == [(0, 1, "T", None, False), (2, 2, "A", 0, False), (3, 3, "A1", 2, True), (4, 3, "A2", 2, True), (5, 2, "B", 0, False), (6, 3, "B1", 5, False), (7, 4, "B11", 6, True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_owners_equal_containment(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7)))
    texts = [(g, i, " ".join(word() for _ in range(rng.choice([5, 60, 90])))) for i, g in enumerate(rng.choices("xy", k=14))] + [("x", 90, None), (None, 91, "a b " * 80), ("x", 92, ""), ("x", 93, "same " * 60)]
    prompts = []
    for j in range(20):
        g, _, t = rng.choice(texts[:14])
        head = f"{word()} " * rng.randint(0, 40)
        prompts.append((rng.choice("xy"), 100 + j, head + "\n" + t.replace(" ", "  ") + " " + word() * rng.randint(0, 3)))
    prompts += [("x", 200, None), ("x", 201, "z " * 500 + "same " * 80), (None, 202, "a b " * 90)]
    squeeze = lambda s: " ".join(s.split())
    want = {(g, i, p) for g, i, t in texts for h, p, q in prompts if g and g == h and t and q and len(squeeze(t)) >= W.HEAD and squeeze(t)[: W.HEAD] in squeeze(q)}
    a, b = spark.createDataFrame(texts, "g string, id long, text string"), spark.createDataFrame(prompts, "g string, prompt_id long, prompt string")
    got = W.owners(a, b, ["g"]).collect()
    assert {(r.g, r.id, r.prompt_id) for r in got} == want and len(got) == len(want) > 0
    assert W.owners(a.limit(0), b, ["g"]).count() == W.owners(a, b.limit(0), ["g"]).count() == 0


def test_references(spark):
    text = "# Title\n1. not one\n## 4. References:\n[1] First, 123456789\n2. Second\n1) again\nnote\n99999999999. too big\n## After\n3. no"
    df = spark.createDataFrame([(1, text), (2, None), (3, "no heading\n1. x"), (4, "## References")], "d int, t string")
    assert {(r.d, r.n, r.body, r.calls) for r in W.references(df, "d", "t").collect()} == {(1, 1, "First, 123456789", 2), (1, 2, "Second", 1)}


def test_calls_meet_lines_in_order(spark):
    calls = spark.sql("select * from values ('q', 1, timestamp'2026-01-01 00:00:00'), ('q', 2, timestamp'2026-01-01 00:10:00'), ('q', 3, timestamp'2026-01-01 02:00:00'), ('p', 4, timestamp'2026-01-01 00:00:00') as t(k, call, t)")
    log = spark.sql("select * from values ('q', 11, timestamp'2026-01-01 00:00:05'), ('q', 12, timestamp'2026-01-01 00:10:01'), ('q', 13, timestamp'2026-01-01 09:00:00') as t(k, line, t)")
    got = {(r.call, r.line) for r in W.nearest_unused(calls, log, ["k"], 60).collect()}
    assert got == {(1, 11), (2, 12), (3, None), (4, None)}


def test_graph_distance():
    node = lambda *p: {"pmids": list(p)}
    edge = lambda x, y: {"x": x, "y": y}
    a = [node("1"), node("2"), node("3")]
    path = [edge(1, 2), edge(2, 3)]
    assert graph_distance(a, path, a, path) == pytest.approx(0, abs=1e-3)
    turned = [a[2], a[0], a[1]]
    assert graph_distance(a, path, turned, [edge(2, 3), edge(3, 1)]) == pytest.approx(0, abs=1e-3)
    apart = graph_distance(a, path, [node("7"), node("8")], None)
    assert 0.5 < apart <= 1 and graph_distance([], None, a, path) is None and graph_distance(None, None, a, path) is None
    assert node_costs([["1", "2"], []], [["2"], []]).tolist() == [[0.5, 1.0], [1.0, 1.0]]
    # One node against one: no choice of a plan.
    assert fused_distance(np.array([[0.4]]), np.zeros((1, 1)), np.ones((1, 1))) == pytest.approx(0.7)
