"""Queries that compare texts by cosine: matrices, thresholds, headings and sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import cosine as S
from paperloom.operators.assignment import one_to_one
from paperloom.operators.matching import token_set_ratio
from paperloom.session import Workspace
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col
#: The least cosine of a match of claims, and of headings; the reviews and sentences of the null.
CLAIM_COSINE, HEADING_COSINE, NULL_REVIEWS, NULL_SENTENCES, NULL_QUANTILE, EDGE_QUANTILE = 0.70, 0.60, 2, 400, 0.95, 0.10


def _titles(spark, f):
    """by task: headings of the outlines (per system) and of the sections, each once."""
    ours = latest(table(spark, f, "outline_nodes"), ["system", "task", "id"]).select("system", "task", T.heading(C("title")).alias("a")).where("a <> ''").distinct()
    theirs = D.sections(spark, f, "title").select("task", T.heading(C("title")).alias("b")).where("b <> ''").distinct()
    return ours, theirs


def v08_cosine_matrix(spark, f):
    """Cosines of every outline heading of a task with every section heading, where they are not 0."""
    ours, theirs = _titles(spark, f)
    a = ours.select("task", "a").distinct().withColumn("tokens", T.pool_tokens(C("a")))
    return S.cosine_cells(a, theirs.withColumn("tokens", T.pool_tokens(C("b"))), ["task"])


def j07_heading_cosine(spark, f):
    """Headings of an outline and of the sections matched one to one by cosine, best first."""
    ours, theirs = _titles(spark, f)
    a = ours.select("task", "a").distinct().withColumn("tokens", T.pool_tokens(C("a")))
    near = S.cosine_join(a, theirs.withColumn("tokens", T.pool_tokens(C("b"))), ["task"], HEADING_COSINE)
    edges = ours.join(near, ["task", "a"]).select("system", "task", "a", "b", "cosine")
    return one_to_one(edges, ["system", "task"], "a", "b", [("cosine", True), ("a", True), ("b", True)], Workspace(spark, "headings"))


def _squeezed(text):
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def j09_channel(spark, f):
    """For each scored claim the sentence of its task, a claim without a score, that says it: word for word, else of cosine 0.70 and more.

    Of equal sentences that of the smallest id.
    """
    c = D.claims(spark, f, "text", "groundedness").where("text <> '' and task is not null").select("task", "id", _squeezed(C("text")).alias("norm"), C("groundedness").isNull().alias("said"))
    sizes = table(spark, f, "claims").groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    return S.sayings(c.where("not said or length(norm) >= 20"), "task", sizes, CLAIM_COSINE)


def j08_section_match(spark, f):
    """Sections of a task in order of id, each matched to the unused section that says its claims, of the nearest heading.

    A section qualifies if a sentence in it is matched to a claim of the first, and if the headings are
    alike: a token-set ratio of 80 or a cosine of 0.60 and more.  Of those the one of greatest cosine
    is taken, then of smallest id.
    """
    placed = D.claims(spark, f, "section_id")
    hit = j09_channel(spark, f).join(placed.select("id", C("section_id").alias("section")), "id").join(placed.select(C("id").alias("sentence"), C("section_id").alias("part")), "sentence")
    shared = hit.where("section is not null and part is not null").select("task", "section", "part").distinct()
    heads = D.sections(spark, f, "title").select("task", "id", T.heading(C("title")).alias("h")).where("h <> ''")
    both = shared.join(heads.select("task", C("id").alias("section"), C("h").alias("p")), ["task", "section"]).join(heads.select("task", C("id").alias("part"), C("h").alias("q")), ["task", "part"])
    pairs = both.select("task", "section", "part", "p", "q", T.pool_tokens(C("p")).alias("x"), T.pool_tokens(C("q")).alias("y"))
    compared = pairs.mapInArrow(S._cosine(6), "task string, section string, part string, p string, q string, cosine double")

    def alike(batches):
        for pdf in batches:
            ok = [c >= HEADING_COSINE or token_set_ratio(p, q) >= 80 for p, q, c in zip(pdf["p"], pdf["q"], pdf["cosine"])]
            yield pdf[ok][["task", "section", "part", "cosine"]]

    edges = compared.mapInPandas(alike, "task string, section string, part string, cosine double")
    return one_to_one(edges, ["task"], "section", "part", [("section", False), ("cosine", True), ("part", False)], Workspace(spark, "sections"))


def j10_null_threshold(spark, f):
    """tau of each task: the 0.95 quantile of its claims' best cosines to sentences of two reviews of other topics.

    A task's topic is its cutoff.  Each topic puts up its two reviews of smallest digest; a task draws
    two of those of other topics by a digest of both names.  What is broadcast is bounded by the
    number of topics, which are years: two reviews of 400 sentences for each.
    """
    claims = D.claims(spark, f, "text").where("text <> '' and task is not null").select("task", "id", "text")
    tasks = D.tasks(spark, f).select("task", F.coalesce("cutoff", F.lit(-1)).alias("topic"))
    up = Window.partitionBy("topic").orderBy(F.sha2("task", 256))
    offered = tasks.withColumn("_r", F.row_number().over(up)).where(C("_r") <= NULL_REVIEWS).select(C("task").alias("review"), C("topic").alias("other"))
    drawn = Window.partitionBy("task").orderBy(F.sha2(F.concat_ws(":", "task", "review"), 256))
    picks = tasks.join(F.broadcast(offered), C("topic") != C("other")).withColumn("_r", F.row_number().over(drawn)).where(C("_r") <= NULL_REVIEWS)
    said = claims.where("length(text) >= 20").join(F.broadcast(offered), C("task") == C("review"), "left_semi")
    kept = said.withColumn("_r", F.row_number().over(Window.partitionBy("task").orderBy("id"))).where(C("_r") <= NULL_SENTENCES)
    sets: dict[str, list] = {r["review"]: [] for r in offered.collect()}
    for r in kept.select("task", T.pool_tokens(C("text")).alias("t")).collect():  # at most 2 x 400 rows per topic
        sets[r["task"]].append(r["t"])
    texts = claims.join(picks.select("task", "review"), "task").select(F.struct("task", "id").alias("key"), "review", T.pool_tokens(C("text")).alias("tokens"))
    best = S.best_cosines(texts, "key", "review", sets).groupBy("key").agg(F.max("best").alias("best"))
    tau = best.groupBy(C("key.task").alias("task")).agg(F.percentile("best", F.lit(NULL_QUANTILE)).alias("tau"), F.count(F.lit(1)).alias("claims"))
    return tau.select("task", F.round("tau", 8).alias("tau"), F.round(F.greatest(F.lit(CLAIM_COSINE), C("tau")), 8).alias("used"), "claims")


def _edge_cosines(spark, f):
    """task, a, b, cosine of the restatement pairs of each task whose claims exist and have words."""
    u = table(spark, f, "units").select("task", F.explode("restatements").alias("r")).select("task", F.least("r.source_id", "r.target_id").alias("a"), F.greatest("r.source_id", "r.target_id").alias("b")).where("a < b").distinct()
    texts = D.claims(spark, f, "text").select("id", T.pool_tokens(C("text")).alias("tokens")).where("size(tokens) > 0")
    both = u.join(texts.select(C("id").alias("a"), C("tokens").alias("x")), "a").join(texts.select(C("id").alias("b"), C("tokens").alias("y")), "b")
    return both.select("task", "a", "b", "x", "y").mapInArrow(S._cosine(6), "task string, a string, b string, cosine double")


def j11_pair_cosine(spark, f):
    return _edge_cosines(spark, f)


def j11_edge_threshold(spark, f):
    """The 0.10 quantile of the cosines of each task's own pairs."""
    return _edge_cosines(spark, f).groupBy("task").agg(F.round(F.percentile("cosine", F.lit(EDGE_QUANTILE)), 8).alias("tau"), F.count(F.lit(1)).alias("n"))


_STOP = ", ".join(f"'{w}'" for w in T.POOL_STOP)
_TOK = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
_HEAD = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+', ''), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g')"
_TF = lambda name, source, keys, column: f"{name} AS (SELECT {keys}, t, count(*) AS tf FROM (SELECT {keys}, unnest({_TOK(column)}) AS t FROM {source}) GROUP BY ALL), {name}n AS (SELECT {keys}, sum(tf * tf) AS s FROM {name} GROUP BY ALL)"
_NODES = "node AS (SELECT * FROM outline_nodes QUALIFY row_number() OVER (PARTITION BY system, task, id ORDER BY loaded_at DESC) = 1)"
_MATRIX = f"""{D.with_sql('section')}, {_NODES}, x AS (SELECT DISTINCT task, {_HEAD('title')} AS a FROM node WHERE title IS NOT NULL), y AS (SELECT DISTINCT task, {_HEAD('title')} AS b FROM section WHERE title IS NOT NULL),
{_TF('p', 'x', 'task, a', 'a')}, {_TF('q', 'y', 'task, b', 'b')},
cell AS (SELECT d.task, d.a, d.b, round(d.dot / sqrt(pn.s::DOUBLE * qn.s), 6) AS cosine FROM (SELECT p.task, a, b, sum(p.tf * q.tf) AS dot FROM p JOIN q ON p.task = q.task AND p.t = q.t GROUP BY ALL) d JOIN pn ON pn.task = d.task AND pn.a = d.a JOIN qn ON qn.task = d.task AND qn.b = d.b)"""
_SQUEEZE = lambda c: rf"lower(trim(regexp_replace({c}, '[ \t\n\r\f\v]+', ' ', 'g')))"
_EDGE = f"""{D.with_sql('claim')}, u AS (SELECT DISTINCT task, least(r.source_id, r.target_id) AS a, greatest(r.source_id, r.target_id) AS b FROM (SELECT task, unnest(restatements) AS r FROM units) WHERE r.source_id <> r.target_id),
{_TF('p', 'claim', 'id', 'text')},
m AS MATERIALIZED (SELECT u.task, u.a, u.b, p.t, p.tf FROM u JOIN p ON p.id = u.a),
d AS (SELECT m.task, m.a, m.b, sum(m.tf * y.tf) AS dot FROM m JOIN p y ON y.id = m.b AND y.t = m.t GROUP BY ALL),
e AS (SELECT u.task, u.a, u.b, round(coalesce(d.dot, 0) / sqrt(o.s::DOUBLE * n.s), 6) AS cosine FROM u JOIN pn o ON o.id = u.a JOIN pn n ON n.id = u.b LEFT JOIN d ON d.task = u.task AND d.a = u.a AND d.b = u.b)"""

ORACLE = {
    "v08_cosine_matrix": f"{_MATRIX} SELECT task, a, b, cosine FROM cell",
    "j09_channel": f"""{D.with_sql('claim')}, c AS (SELECT task, id, groundedness, {_SQUEEZE('text')} AS norm FROM claim WHERE text <> '' AND task IS NOT NULL),
s AS (SELECT task, norm AS b, min(id) AS sentence FROM c WHERE groundedness IS NULL AND length(norm) >= 20 GROUP BY 1, 2), g AS (SELECT task, id, norm AS a FROM c WHERE groundedness IS NOT NULL),
ex AS (SELECT g.task, g.id, s.sentence FROM g JOIN s ON s.task = g.task AND s.b = g.a), o AS (SELECT * FROM g WHERE id NOT IN (SELECT id FROM ex)),
{_TF('p', 'o', 'task, id', 'a')}, {_TF('q', 's', 'task, sentence', 'b')},
cell AS (SELECT d.task, d.id, d.sentence, round(d.dot / sqrt(pn.s::DOUBLE * qn.s), 6) AS cosine FROM (SELECT p.task, id, sentence, sum(p.tf * q.tf) AS dot FROM p JOIN q ON p.task = q.task AND p.t = q.t GROUP BY ALL) d JOIN pn ON pn.task = d.task AND pn.id = d.id JOIN qn ON qn.task = d.task AND qn.sentence = d.sentence)
SELECT task, id, sentence, 1.0 AS cosine, 'exact' AS kind FROM ex UNION ALL (SELECT task, id, sentence, cosine, 'near' FROM cell WHERE cosine >= 0.70 QUALIFY row_number() OVER (PARTITION BY task, id ORDER BY cosine DESC, sentence) = 1)""",
    "j10_null_threshold": f"""{D.with_sql('claim', 'task')}, k AS (SELECT task, coalesce(cutoff, -1) AS topic FROM task), up AS (SELECT task AS review, topic AS other FROM k QUALIFY row_number() OVER (PARTITION BY topic ORDER BY sha256(task)) <= 2),
pick AS (SELECT k.task, review FROM k JOIN up ON other <> topic QUALIFY row_number() OVER (PARTITION BY k.task ORDER BY sha256(k.task || ':' || review)) <= 2),
said AS (SELECT task, id, text FROM claim WHERE length(text) >= 20 QUALIFY row_number() OVER (PARTITION BY task ORDER BY id) <= 400), own AS (SELECT task, id, text FROM claim WHERE text <> '' AND task IS NOT NULL),
{_TF('p', 'own', 'task, id', 'text')}, {_TF('q', 'said', 'task, id', 'text')},
d AS (SELECT p.task, p.id, q.id AS s, q.task AS review, sum(p.tf * q.tf) AS dot FROM p JOIN pick ON pick.task = p.task JOIN q ON q.task = pick.review AND q.t = p.t GROUP BY ALL),
b AS (SELECT own.task, own.id, coalesce(max(round(d.dot / sqrt(pn.s::DOUBLE * qn.s), 6)), 0) AS best FROM own LEFT JOIN d ON d.task = own.task AND d.id = own.id LEFT JOIN pn ON pn.task = d.task AND pn.id = d.id LEFT JOIN qn ON qn.task = d.review AND qn.id = d.s WHERE own.task IN (SELECT task FROM pick) GROUP BY 1, 2)
SELECT task, round(quantile_cont(best, 0.95), 8) AS tau, round(greatest(0.7, quantile_cont(best, 0.95)), 8) AS used, count(*) AS claims FROM b GROUP BY task""",
    "j11_pair_cosine": f"{_EDGE} SELECT task, a, b, cosine FROM e",
    "j11_edge_threshold": f"{_EDGE} SELECT task, round(quantile_cont(cosine, 0.10), 8) AS tau, count(*) AS n FROM e GROUP BY task",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "j07_heading_cosine", "j08_section_match"]}
