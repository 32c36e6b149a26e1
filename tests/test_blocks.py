"""Search over blocks against the search over postings, and how many rows it moves."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.functions.text import pool_tokens
from paperloom.operators import blocks as K
from paperloom.operators import lexical as L

WORDS = [f"w{i}" for i in range(40)]


def corpus(spark, n, parts=3):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 2000, 2005, 2010, 2020]), None if i % 11 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "pmid long, year int, title string").repartition(parts)


def asked(spark, n):
    rng = random.Random(6)
    rows = [(f"q{i}", " ".join(rng.choices([*WORDS, "unknown"], k=rng.randint(0, 5))), rng.choice([None, 1990, 2005, 2030]), rng.choice([None, i + 1])) for i in range(n)]
    return spark.createDataFrame(rows, "qid string, query string, cutoff int, review_pmid long")


def moved(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_equals_search_over_postings(spark):
    docs, q = corpus(spark, 300).cache(), asked(spark, 40).cache()
    posts = L.index(docs, "pmid", pool_tokens(F.col("title")), max_fraction=0.3)
    want = L.search(q, pool_tokens(F.col("query")), posts, docs.select("pmid", "year"), "pmid", 7).select("qid", "pmid", "score", "rank", "total").collect()
    packed = K.pack(docs, "pmid", "year", F.array("title"))
    got = K.search(packed, q, pool_tokens(F.col("query")), "pmid", 7, max_fraction=0.3).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_few_queries_over_many_blocks(spark):
    """The blocks of one query are shared out among tasks, and their best are merged."""
    docs, q = corpus(spark, 200, 5).cache(), asked(spark, 1).withColumn("query", F.lit("w1 w2 w3")).withColumn("cutoff", F.lit(2030))
    posts = L.index(docs, "pmid", pool_tokens(F.col("title")))
    want = L.search(q, pool_tokens(F.col("query")), posts, docs.select("pmid", "year"), "pmid", 9).select("qid", "pmid", "score", "rank", "total").collect()
    got = K.search(K.pack(docs, "pmid", "year", F.array("title")), q, pool_tokens(F.col("query")), "pmid", 9).collect()
    assert len(want) == 9 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_listed(spark):
    docs = corpus(spark, 300).cache()
    q = asked(spark, 40).withColumn("listed", F.array(*[F.lit(i).cast("long") for i in (1, 2, 5, 8, 8, 30, 999)], F.lit(None).cast("long"))).cache()
    posts = L.index(docs, "pmid", pool_tokens(F.col("title")))
    scored = L.search_scores(q, pool_tokens(F.col("query")), posts, docs.select("pmid", "year"), "pmid")
    allow = q.select("qid", "cutoff", "review_pmid", F.explode(F.array_distinct("listed")).alias("pmid")).join(docs, "pmid")
    allow = allow.where(L.searchable(F.col("year"), F.col("cutoff")) & ~F.col("pmid").eqNullSafe(F.col("review_pmid"))).select("qid", "pmid")
    want = L.allowlisted(scored, allow, "pmid").collect()
    got = L.ranked_list(K.listed_scores(K.pack(docs, "pmid", "year", F.array("title")), q, pool_tokens(F.col("query")), "listed", "pmid"), "pmid").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_empty_sides(spark):
    docs, q = corpus(spark, 20), asked(spark, 5)
    tokens = pool_tokens(F.col("query"))
    assert K.search(K.pack(docs.limit(0), "pmid", "year", F.array("title")), q, tokens, "pmid", 3).count() == 0
    assert K.search(K.pack(docs, "pmid", "year", F.array("title")), q.limit(0), tokens, "pmid", 3).count() == 0
    assert K.search(K.pack(docs.withColumn("pmid", F.lit(None).cast("long")), "pmid", "year", F.array("title")), q, tokens, "pmid", 3).count() == 0


def test_l07_moves_no_row_per_match(spark, monkeypatch):
    """200 queries match 400 papers each, of which ten are asked for: matches must not be shuffled."""
    from paperloom.plans import search

    docs = spark.createDataFrame([(i, f"gene w{i}", "text", 2000) for i in range(400)] + [(i, "other", "thing", 2000) for i in range(1000, 2200)], "pmid long, title string, abstract string, year int")
    q = spark.createDataFrame([(f"q{i}", "gene", 2020, None) for i in range(200)], "qid string, query string, cutoff int, review_pmid long")
    monkeypatch.setattr(search.D, "corpus", lambda *_: docs)
    monkeypatch.setattr(search.D, "queries", lambda *_: q)
    before = moved(spark)
    rows = search.l07_search(spark, "").collect()
    assert len(rows) == 2000 and {r.total for r in rows} == {400}
    assert moved(spark) - before < 200 * 400 / 4


def moved_by(spark, monkeypatch, name):
    """Rows that a query shuffles where 200 questions match 400 papers each, and its result."""
    from paperloom.plans import search

    docs = spark.createDataFrame([(i, f"gene w{i}", "A gene. Text.", 2000, i) for i in range(400)] + [(i, "other", "thing", 2000, i) for i in range(1000, 2200)], "pmid long, title string, abstract string, year int, row long")
    q = spark.createDataFrame([(f"q{i}", "gene", 2020, None) for i in range(200)], "qid string, query string, cutoff int, review_pmid long")
    units = spark.createDataFrame([(f"q{i}", ["3"], ["7", "1000"]) for i in range(200)], "task string, hubs array<string>, tail array<string>")
    monkeypatch.setattr(search.D, "corpus", lambda *_: docs)
    monkeypatch.setattr(search.D, "queries", lambda *_: q)
    monkeypatch.setattr(search.D, "tasks", lambda *_: units)
    before = moved(spark)
    rows = getattr(search, name)(spark, "").collect()
    return moved(spark) - before, rows


def test_l13_best_sentence_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l13_best_sentence")
    assert n < 200 * 400 / 4 and len(rows) == 200 * 200 and {(r.k, r.overlap) for r in rows} == {(0, 1)}


def test_l14_normalised_scores_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l14_normalised_scores")
    assert n < 200 * 400 / 4 and len(rows) == 2000 and max(r.relevance for r in rows) == 0.9


def test_l09_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l09_allowlisted_search")
    assert n < 200 * 400 / 4 and [r.pmid for r in sorted(rows, key=lambda r: (r.qid, r["rank"]))[:3]] == [3, 7, 1000]


def test_l13_snippets_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l13_snippets")
    assert n < 200 * 400 / 4 and len(rows) == 2000 and {r.start for r in rows} == {0}


def test_l11_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l11_page")
    assert n < 200 * 400 / 4 and len(rows) == 1000 and {r.next for r in rows} == {10}


def test_l14_metered_moves_no_row_per_match(spark, monkeypatch):
    n, rows = moved_by(spark, monkeypatch, "l14_metered")
    assert n < 200 * 400 / 4 and len({r.pmid for r in rows}) == 10
