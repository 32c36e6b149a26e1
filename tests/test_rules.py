"""Rankings, readouts, resolving joins, files and streams."""

from __future__ import annotations

import gzip
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import matching as M
from paperloom.operators import ranking as K
from paperloom.operators import readouts as R
from paperloom.sources import files
from paperloom.sources.tables import latest
from paperloom.streaming import calllog


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), ("a", 2, "y")], "k string, loaded_at int, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"]).collect()} == {("a", "y"), ("b", "z"), (None, "n")}


def test_rankings(spark):
    df = spark.createDataFrame([("a", i, 10 * i) for i in range(1, 6)] + [("b", 1, 99)], "g string, o int, n int")
    assert {(r.g, r.o, r["rank"]) for r in K.top_k(df, ["g"], [F.col("o").desc()], 2).collect()} == {("a", 5, 1), ("a", 4, 2), ("b", 1, 1)}
    assert {(r.g, r.o) for r in K.fit_to_budget(df, ["g"], ["o"], F.col("n"), 35).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert {(r.g, r.o) for r in K.whole_until(df, ["g"], ["o"], F.col("n"), 30).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert {(r.g, r.o) for r in K.round_robin(df, ["g"], [F.col("o")], ["g"], 3).collect()} == {("a", 1), ("b", 1), ("a", 2)}
    seats = K.largest_remainder(spark.createDataFrame([("x", 5), ("y", 3), ("z", 2)], "k string, w int"), "k", "w", 7)
    assert {r.k: r.seats for r in seats.collect()} == {"x": 4, "y": 2, "z": 1}
    runs = K.islands(spark.createDataFrame([("r", i, v) for i, v in enumerate("aabba")], "run string, o int, v string"), ["run"], "o", "v")
    assert {(r.v, r["first"], r["last"], r.n) for r in runs.collect()} == {("a", 0, 1, 2), ("b", 2, 3, 2), ("a", 4, 4, 1)}


def test_readouts(spark):
    rng = random.Random(3)
    rows = [("t", f"p{i}", rng.choice("AB"), rng.choice("XYZ")) for i in range(25)]
    r = R.pair_agreement(spark.createDataFrame(rows, "task string, pmid string, human string, system string")).first()
    tp = fp = fn = tn = 0
    for (_, _, h, s), (_, _, k, u) in itertools.combinations(rows, 2):
        tp, fp, fn, tn = tp + (h == k and s == u), fp + (h != k and s == u), fn + (h == k and s != u), tn + (h != k and s != u)
    assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
    members = spark.createDataFrame([("t", "hub", "1", 3), ("t", "hub", "2", 1), ("t", "none", "3", 0)], "task string, stratum string, pmid string, weight int")
    given = spark.createDataFrame([("t", "1"), ("t", "1"), (None, "2")], "task string, pmid string")
    assert {x.stratum: x.recall for x in R.weighted_recall(members, given).collect()} == {"hub": 0.75, "none": None}


def test_near_repeats(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(g, i, sorted(set(rng.choices(words, k=rng.choice([0, 2, 5, 8]))))) for g in "gh" for i in range(40)]
    df = spark.createDataFrame([(g, i, t, " ".join(t) or "empty") for g, i, t in rows], "g string, i int, toks array<string>, norm string")
    got = {(r.g, r.i): (r.earlier, round(r.similarity, 6), r.kind) for r in M.near_repeats(df, "g", "i", "toks", "norm").collect()}
    want = {}
    for g, i, t in rows:
        for h, j, u in rows:
            if g == h and j < i and (t == u):
                want.setdefault((g, i), (j, 1.0, "exact"))
        for h, j, u in rows:
            if g == h and j < i and t and u and (g, i) not in want and len({*t} & {*u}) / len({*t} | {*u}) >= 0.8:
                want[g, i] = (j, round(len({*t} & {*u}) / len({*t} | {*u}), 6), "near")
    assert got == want


def test_headings(spark):
    assert M.token_set_ratio("gene control in yeast", "yeast gene control in") == 100
    assert M.token_set_ratio("abc", "") == 0 and M.token_set_ratio("alpha beta", "gamma") < 50
    ours = spark.createDataFrame([("t", "Gene control"), ("t", "Control of genes"), ("t", None), ("t", "")], "task string, title string")
    theirs = spark.createDataFrame([("t", "gene control"), ("t", "unrelated")], "task string, title string")
    assert [(r.ours, r.theirs) for r in M.match_headings(ours, theirs, "task").collect()] == [("Gene control", "gene control")]
    assert M.match_headings(ours.limit(0), theirs, "task").count() == 0


def test_headings_lose_no_pair(spark):
    """Every system is matched, and all pairs that reach the score meet, with a common word or without."""
    assert M.token_set_ratio("method", "methods") == pytest.approx(92.3, abs=0.1)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 7)))
    titles = [sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(25)} | {"method" + "s" * k}) for k in (0, 1, 1)]
    ours = spark.createDataFrame([(s, "t", x) for s, mine in zip("pq", titles) for x in mine], "system string, task string, title string")
    theirs = spark.createDataFrame([("t", x) for x in titles[2]], "task string, title string")
    got = {(r.system, r.ours, r.theirs) for r in M.match_headings(ours, theirs, "task", per=("system",)).collect()}
    want = set()
    for system, mine in zip("pq", titles):
        free_a, free_b = set(mine), set(titles[2])
        for score, a, b in sorted(((M.token_set_ratio(x, y), x, y) for x in mine for y in titles[2]), reverse=True):
            if score >= 80 and a in free_a and b in free_b:
                want.add((system, a, b))
                free_a.remove(a)
                free_b.remove(b)
    assert got == want and {("p", "method", "methods"), ("q", "methods", "methods")} <= got


def test_j06_matches_all_systems(spark, monkeypatch):
    from paperloom.plans import checks

    nodes = spark.createDataFrame([(s, "t", "1", "Methods", 1) for s in ("tessel", "orrery")], "system string, task string, id string, title string, loaded_at int")
    monkeypatch.setattr(checks, "table", lambda *_: nodes)
    monkeypatch.setattr(checks.D, "sections", lambda *_: spark.createDataFrame([("t", "1. Method")], "task string, title string"))
    assert {(r.system, r.theirs) for r in checks.j06_heading_match(spark, "").collect()} == {("tessel", "method"), ("orrery", "method")}


def test_cascade_and_checks(spark):
    rows = spark.createDataFrame([(1, "d1", "t1"), (2, None, "t1"), (3, None, "t2"), (4, None, None)], "id int, d string, t string")
    known = spark.createDataFrame([(10, "d1", "t9"), (11, None, "t1"), (12, None, "t2"), (13, None, "t2")], "pmid int, d string, t string")
    got = M.cascade(rows, "pmid", [("doi", "d", M.unique_by(known, "d", "pmid")), ("title", "t", M.unique_by(known, "t", "pmid"))])
    assert {r.id: (r.pmid, r.matched_by) for r in got.collect()} == {1: (10, "doi"), 2: (11, "title"), 3: (None, "none"), 4: (None, "none")}
    new = spark.createDataFrame([(2, "x", "y")], "id int, d string, t string")
    assert {(r.id, r.d) for r in M.upsert(rows, new, ["id"]).collect()} == {(1, "d1"), (2, "x"), (3, None), (4, None)}


def test_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"k": 1}\n\n{"k": 2}\nbroken\n')
    (tmp_path / "b.jsonl.gz.part").write_text("{}")
    df = files.read_shards(spark, [str(tmp_path), str(tmp_path) + "/"], "k int")
    assert sorted(r.k for r in df.where("k is not null").collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        files.read_shards(spark, [str(tmp_path)], "k int", "*.none")
    kept = files.read_json_lines(spark, str(tmp_path / "a.jsonl.gz"), "k int", keep_broken=True)
    assert kept.cache().where("_broken is not null").count() == 1
    assert files.read_json_lines(spark, str(tmp_path / "a.jsonl.gz"), "k int").where("k is not null").count() == 2
    (tmp_path / "m.tsv").write_text("id\tname\n1\tx\n")
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "m.tsv"), ["id", "name", "profile"]).collect()] == [("1", "x", None)]
    for text in ('{"a": 2001}', '{"task": "a", "cutoff": 2001}', '[{"task": "a", "cutoff": 2001}]'):
        assert [tuple(r) for r in files.cutoffs(spark, text).collect()] == [("a", 2001)]
    with pytest.raises(ValueError):
        files.cutoffs(spark, '{"a": 1492}')
    target = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert files.write_if_changed(df, target, ["k"]) and not files.write_if_changed(df, target, ["k"])
    assert files.write_if_changed(df.union(df), target, ["k"]) and spark.read.parquet(target).count() == 2


ARTICLE = """<article><front><article-meta><article-id pub-id-type="pmid">77</article-id><title-group><article-title>On <i>X</i></article-title></title-group>
<contrib-group><contrib><name><surname>Doe</surname><given-names>J</given-names></name></contrib></contrib-group></article-meta></front>
<body><sec><title>One</title><p>Text <xref ref-type="bibr" rid="r1 r2">[1,2]</xref>.</p><sec><title>Inner</title><p>More.</p></sec></sec></body>
<back><ref-list><ref id="r1"><mixed-citation>A <pub-id pub-id-type="pmid">5</pub-id></mixed-citation></ref></ref-list></back></article>"""


def test_articles(spark):
    df = spark.createDataFrame([(ARTICLE, 1), ("<broken", 2), (None, 3)], "xml string, text int")
    rows = files.articles(df, "xml").collect()
    assert [(r.kind, r.ord, r.parent, r.text) for r in rows if r.kind in ("title", "author", "section")] == [("title", 0, None, "On X"), ("author", 0, None, "Doe J"), ("section", 0, None, "One"), ("section", 1, 0, "Inner")]
    assert [(r.parent, r.refs) for r in rows if r.kind == "paragraph"] == [(0, ["r1", "r2"]), (1, [])]
    assert [r.refs for r in rows if r.kind == "reference"] == [["r1", "5"]]
    assert files.articles(df.limit(0), "xml").count() == 0


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = lambda run, seq, t, kind: json.dumps({"run": run, "seq": seq, "t": t, "kind": kind, "prompt_tokens": 5})
    (log / "1.json").write_text("\n".join([line("a", 1, "2024-01-01T00:00:01", "search"), line("a", 1, "2024-01-01T00:00:01", "search"), "broken", line("a", 2, "2024-01-01T00:03:00", "llm")]))
    (log / "2.json").write_text(line("a", 2, "2024-01-01T00:03:00", "llm") + "\n" + line("b", 1, "2024-01-01T00:20:00", "llm"))
    out = str(tmp_path / "out")
    calllog.append(calllog.once(calllog.read_log(spark, str(log), 1)).where("run is not null"), out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted((r.run, r.seq) for r in spark.read.parquet(out).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    q = calllog.totals(calllog.read_log(spark, str(log))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.run, r.calls, r.searches, r.tokens) for r in spark.table("totals").where("run is not null").collect()}
    assert got == {("a", 4, 2, 20), ("b", 1, 0, 5)}


def test_docstore_is_whole(spark, monkeypatch):
    from paperloom.plans import extras

    corpus = spark.createDataFrame([(i, f"t{i}", 2000, i) for i in (99, 100, 101)], "pmid long, title string, year int, n_citation int")
    monkeypatch.setattr(extras.D, "corpus", lambda *_: corpus)
    assert {(r.pmid, r.title) for r in extras.s15_docstore(spark, "").collect()} == {(99, "t99"), (100, "t100"), (101, "t101")}
