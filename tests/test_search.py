"""Index, visibility and vector search on small fixtures with known results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions.text import pool_tokens
from paperloom.operators import graph as G
from paperloom.operators import lexical as L
from paperloom.operators import vectors as V

CORPUS = [(1, 2019, "gene regulation in yeast"), (2, 2020, "gene regulation in yeast"), (3, None, "gene regulation"), (4, 2010, "gene regulation review"), (5, 2021, "gene regulation"), (6, 2015, "protein folding")]


def found(spark, cutoff, exclude=None, year_min=None):
    docs = spark.createDataFrame(CORPUS, "pmid long, year int, title string")
    posts = L.index(docs, "pmid", pool_tokens(F.col("title")), max_fraction=1.0)
    q = spark.createDataFrame([("q", "gene regulation", cutoff, exclude)], "qid string, query string, cutoff int, review_pmid long")
    hits = L.search_scores(q, pool_tokens(F.col("query")), posts, docs.select("pmid", "year"), "pmid")
    if year_min:
        hits = hits.join(docs, "pmid").where(L.searchable(F.col("year"), F.lit(cutoff), F.lit(year_min)))
    return {r.pmid for r in hits.collect()}


def test_cutoffs(spark):
    assert found(spark, 2020) == {1, 2, 3, 4}
    assert found(spark, 2019, 4) == {1, 3}
    assert found(spark, 2022, None, 2019) == {1, 2, 5}
    assert found(spark, None) == {3}


def test_ranking_paging_and_lists(spark):
    docs = spark.createDataFrame(CORPUS + [(7, 2018, None), (8, 2018, "")], "pmid long, year int, title string")
    posts = L.index(docs, "pmid", pool_tokens(F.col("title")), max_fraction=1.0)
    q = spark.createDataFrame([("q", "gene regulation", 2030, None)], "qid string, query string, cutoff int, review_pmid long")
    ranked = L.search(q, pool_tokens(F.col("query")), posts, docs.select("pmid", "year"), "pmid", 10)
    rows = ranked.orderBy("rank").collect()
    assert [r.pmid for r in rows[:2]] == [3, 5] and {r.total for r in rows} == {5}
    page = L.page(ranked, 2, 2).collect()
    assert {r["rank"] for r in page} == {3, 4} and {r["next"] for r in page} == {4}
    allow = spark.createDataFrame([("q", 1), ("q", 3), ("q", 6)], "qid string, pmid long")
    listed = L.allowlisted(ranked.select("qid", "pmid", "score"), allow, "pmid").orderBy("rank").collect()
    assert [r.pmid for r in listed] == [3, 1, 6] and listed[-1].score == 0
    assert L.index(docs.limit(0), "pmid", pool_tokens(F.col("title"))).count() == 0


def test_best_sentences_of_all_hits(spark, monkeypatch):
    """Each hit of each query has its best sentence, the asking review none; hits without abstract are left out."""
    from paperloom.plans import search

    text = "Nothing here. Gene regulation matters. Regulation of a gene."
    docs = [(i, "gene regulation", text, 2000) for i in range(1, 31)] + [(31, "gene regulation", None, 2000)] + [(i, "other topic", "Protein folding. Yeast.", 2000) for i in range(40, 140)]
    corpus = spark.createDataFrame(docs, "pmid long, title string, abstract string, year int")
    asked = spark.createDataFrame([("p", "gene regulation", 2020, 1), ("q", "gene regulation", 2020, 2), ("r", "yeast", 2020, None)], "qid string, query string, cutoff int, review_pmid long")
    monkeypatch.setattr(search.D, "corpus", lambda *_: corpus)
    monkeypatch.setattr(search.D, "queries", lambda *_: asked)
    got = {(r.qid, r.pmid): (r.k, r.overlap) for r in search.l13_best_sentence(spark, "").where("qid <> 'r'").collect()}
    assert got == {(q, i): (1, 2) for q, own in (("p", 1), ("q", 2)) for i in range(1, 31) if i != own}


def test_vectors_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None), (98, [])], "id long, embedding array<float>")
    q = df.where("id < 7").select(F.col("id").alias("qid"), "embedding")
    x = x.astype(np.float32).astype(float)
    for metric in ("cosine", "inner", "l2"):
        if metric == "l2":
            s = -np.sqrt(((x[:7, None] - x[None]) ** 2).sum(-1))
        else:
            y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
            s = y[:7] @ y.T
        want = {i: list(np.lexsort((np.arange(60), -np.round(s[i], 6)))[:5]) for i in range(7)}
        got = V.nearest(df, q, 5, metric).orderBy("qid", "rank").collect()
        assert {i: [r.id for r in got if r.qid == i] for i in range(7)} == want
    assert V.nearest(df, q.limit(0), 5).count() == 0
    assert V.nearest(df.limit(0), q, 5).count() == 0


def pairs_by_hand(rows, k, least):
    found = {}
    for i, g, p, x in rows:
        near = sorted(((round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 6), j) for j, h, q, y in rows if j != i and h == g and q != p), reverse=True)
        for score, j in near[:k]:
            if score >= least:
                found.setdefault(frozenset((i, j)), (i, j, score))
    return {(a, b): s for a, b, s in found.values()}


def test_candidate_pairs(spark, monkeypatch):
    """Every row proposes, within its group and to other parts, also across blocks."""
    from paperloom.plans import search

    monkeypatch.setattr(V, "PAIR_BLOCK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 3 == 0], i // 4, rng.normal(size=4).astype(np.float32).astype(float)) for i in range(1, 90)]
    df = spark.createDataFrame([(i, g, p, x.tolist()) for i, g, p, x in rows] + [(200, "a", 1, None), (201, None, 1, [1.0] * 4)], "id long, label string, part int, embedding array<float>")
    assert {(r.a, r.b): r.score for r in V.candidate_pairs(df, "label", "part", 6, 0.45).collect()} == pairs_by_hand(rows, 6, 0.45)
    monkeypatch.setattr(search, "_vectors", lambda *_: df.drop("part"))
    assert {(r.a, r.b): r.score for r in search.v09_candidate_pairs(spark, "").collect()} == pairs_by_hand([(i, g, i, x) for i, g, _, x in rows], 6, 0.45)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (1, 3), (3, None), (2, 3)], "src long, dst long")
    assert G.edge_counts(edges).first().asDict() == {"n_raw": 6, "n_loops": 1, "n_repeats": 2, "n_edges": 3}
    assert {r.src: (r.degree, r.neighbours) for r in G.adjacency(G.clean_edges(edges), most=1).collect()} == {1: (2, [2]), 2: (1, [3])}
    assert G.edge_counts(edges.limit(0)).first().n_edges == 0
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    rel = spark.createDataFrame([("x", "y"), ("x", "z")], "src string, dst string")
    assert {r.name: (r.best, r.worst) for r in G.rank_intervals(names, rel).collect()} == {"x": (1, 1), "y": (2, 3), "z": (2, 3)}
    chain = spark.createDataFrame([("x", "y"), ("y", "z")], "src string, dst string")
    assert {r.name: (r.best, r.worst) for r in G.rank_intervals(names, chain).collect()} == {"x": (1, 1), "y": (2, 2), "z": (3, 3)}
    assert G.tierable(names, chain).first().tierable
    partial = spark.createDataFrame([("x", "z")], "src string, dst string")
    assert not G.tierable(names, partial).first().tierable


def test_adjacency_is_whole(spark, monkeypatch):
    """Every neighbour of a hub is in one of its blocks, none above the bound."""
    from paperloom.plans import search

    hub = spark.range(1, 120_001).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    monkeypatch.setattr(search.D, "edges", lambda *_: hub.unionByName(hub.limit(5)).unionByName(spark.createDataFrame([(3, 7), (2, 7)], "src long, dst long")))
    rows = search.g02_adjacency(spark, "").collect()
    blocks = sorted((r.neighbours for r in rows if r.dst == 0), key=lambda n: n[0])
    assert [len(b) for b in blocks] == [50_000, 50_000, 20_000] and [x for b in blocks for x in b] == list(range(1, 120_001))
    assert [(r.dst, r.degree, r.neighbours) for r in rows if r.dst] == [(7, 2, [2, 3])] and {r.degree for r in rows if r.dst == 0} == {120_000}
    numbered = G.adjacency_blocks(spark.createDataFrame([(1, i) for i in range(5)], "src int, dst int"), length=2)
    assert {(r.block, tuple(r.neighbours)) for r in numbered.collect()} == {(0, (0, 1)), (1, (2, 3)), (2, (4,))}
