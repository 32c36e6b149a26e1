"""Queries of the remaining exports, matches, windows and distances."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import alignment as AL
from paperloom.operators import readouts as R
from paperloom.plans import readouts as RO
from paperloom.plans import stats as ST
from paperloom.session import shared_folder
from paperloom.sources import domain as D
from paperloom.sources.flat_index import read_flat_index, write_flat_index
from paperloom.sources.tables import latest, table

C = F.col


def s09_search_log(spark, f):
    """Calls of the search stage: how many listed ids, and the greatest."""
    d = D.draws(spark, f, "stage", "completion").where("stage = 'search'")
    ids = F.regexp_extract_all(F.coalesce("completion", F.lit("")), F.lit("[0-9]{9}"), F.lit(0))
    return d.select("draw_id", F.size(ids).alias("n_returned"), F.array_max(ids).alias("last"))


def s15_docstore(spark, f):
    """All papers by id."""
    return D.corpus(spark, f, "title", "year", "n_citation").select("pmid", "title", "year", "n_citation")


def s19_flat_index(spark, f):
    """The vectors written to index files and read back, with what a search needs of them."""
    folder = f"{shared_folder(spark)}/flat-index-{uuid.uuid4().hex}"
    write_flat_index(D.vectors(spark, f), folder).count()
    return read_flat_index(spark, folder).select("id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("square"))


def t03_term_hash(spark, f):
    """Hashes of the terms of the corpus, and how many terms share one."""
    terms = D.corpus(spark, f, "title").select(F.explode(T.pool_tokens(C("title"))).alias("term")).distinct().withColumn("hash", T.term_hash(C("term")))
    return terms.groupBy("hash").agg(F.min("term").alias("term"), F.count(F.lit(1)).alias("terms"))


def s22_score_table(spark, f):
    s = D.scores(spark, f)
    return s.groupBy("system", "cluster").agg(F.round(F.avg("z"), 6).alias("value"), F.count(F.lit(1)).cast("int").alias("n_units"))


def t31_marker_spans(spark, f):
    """Where the bracketed citations of an abstract begin, in order."""
    p = D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", F.split("abstract", r"\[\s*\d[\d,;\s–-]*\]").alias("gaps"), F.regexp_extract_all("abstract", F.lit(r"\[\s*\d[\d,;\s–-]*\]"), F.lit(0)).alias("marks"))
    rows = p.where("size(marks) > 0").select("pmid", "gaps", "marks", F.posexplode("marks").alias("k", "mark"))
    before = F.aggregate(F.slice("gaps", 1, C("k") + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.when(C("k") > 0, F.aggregate(F.slice("marks", 1, F.greatest(C("k"), F.lit(1))), F.lit(0), lambda a, g: a + F.length(g))).otherwise(0)
    return rows.select("pmid", "k", before.alias("start"), (before + F.length("mark")).alias("end_"))


def v01_id_space(spark, f):
    v = D.vectors(spark, f)
    n = v.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"))
    return n.agg(F.sum("k").alias("rows"), F.min("lo").alias("least_dim"), F.max("hi").alias("most_dim"), F.count_if(C("k") > 1).alias("duplicates"))


def v05_visible_nearest(spark, f):
    """The five nearest dated vectors: the rule applies before the ranking, so no over-fetch is needed."""
    from paperloom.operators.vectors import nearest

    v = D.vectors(spark, f)
    return nearest(v.where("year is not null"), v.where("id % 100 = 0").select(C("id").alias("qid"), "embedding"), 5, "inner").select("qid", "id", "score")


def v10_outermost(spark, f):
    """Calls that no other call of the same minute and run encloses: the first of each."""
    e = table(spark, f, "events").select(C("user_id").alias("run"), F.date_trunc("minute", "ts").alias("m"), "event_id", "ts")
    depth = F.row_number().over(Window.partitionBy("run", "m").orderBy("ts", "event_id")) - 1
    return e.withColumn("depth", depth).groupBy("run").agg(F.count_if(C("depth") == 0).alias("outermost"), F.max("depth").alias("deepest"))


def v12_row_allowlist(spark, f):
    rows = D.corpus(spark, f, "title").select("pmid", F.row_number().over(Window.partitionBy(C("pmid") % 16).orderBy("pmid")).alias("row"), (C("pmid") % 16).alias("shard"))
    listed = D.tasks(spark, f).select("task", "review_pmid", F.explode(F.array_distinct(F.coalesce("tail", F.array().cast("array<string>")))).alias("p")).select("task", "review_pmid", C("p").cast("long").alias("pmid"))
    return listed.where(~C("pmid").eqNullSafe(C("review_pmid"))).join(rows, "pmid").groupBy("task").agg(F.sort_array(F.collect_list(F.struct("shard", "row"))).alias("r")).select("task", F.size("r").alias("n"), C("r")[0]["shard"].alias("shard"), C("r")[0]["row"].alias("row"))


def j16_alignment(spark, f):
    """Alignment of the section kinds of each task with an ideal order."""
    ideal = ["introduction", "background", "methods", "results", "discussion", "conclusion"]
    s = D.sections(spark, f, "parent", "section_type").where("section_type is not null and (parent is null or parent = '')").groupBy("task").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "section_type"))), lambda x: x["section_type"]).alias("kinds"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"task": pdf["task"], "score": [AL.align(list(k), ideal) for k in pdf["kinds"]]})

    return s.mapInPandas(run, "task string, score double")


def j17_relocation(spark, f):
    """Spans of twenty characters found again after the abstract lost its first sentence."""
    p = D.corpus(spark, f, "abstract").where("length(abstract) > 200").select("pmid", "abstract")

    def run(batches):
        import hashlib

        for pdf in batches:
            out = []
            for pmid, text in zip(pdf["pmid"], pdf["abstract"]):
                cut = text.find(". ") + 2
                start = 150
                where, how = AL.relocate(text[cut:], start, 20, hashlib.sha256(text[start : start + 20].encode()).hexdigest())
                out.append((pmid, where, how))
            yield pd.DataFrame(out, columns=["pmid", "place", "how"]).astype({"place": "Int64"})

    return p.mapInPandas(run, "pmid long, place long, how string")


def j28_title_map(spark, f):
    """Numbered reference lines read back to titles, joined by number."""
    c = D.claims(spark, f, "ref_nos", "pmids").where("size(pmids) > 0").select("task", F.explode(F.arrays_zip("ref_nos", "pmids")).alias("z")).where("z.ref_nos is not null and z.pmids is not null").groupBy("task", C("z.ref_nos").alias("n")).agg(F.min("z.pmids").alias("pmid"))
    lines = c.select("task", F.concat(F.lit("["), "n", F.lit("] "), "pmid").alias("line"))
    return lines.select("task", F.regexp_extract("line", r"^\[(\d+)\]\s+(.*)$", 1).cast("int").alias("n"), F.regexp_extract("line", r"^\[(\d+)\]\s+(.*)$", 2).alias("title"))


def a02_community_breadth(spark, f):
    """Share of a task's kinds of sections that the given papers reach, and how deep."""
    given = RO._given(spark, f).withColumn("hit", F.lit(1))
    c = D.claims(spark, f, "section_type", "pmids").where("section_type is not null").select("task", "section_type", F.explode("pmids").alias("pmid")).distinct().join(given, ["task", "pmid"], "left")
    g = c.groupBy("task", "section_type").agg(F.count("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("task").agg(F.round(F.avg((C("h") > 0).cast("int")), 6).alias("breadth"), F.round(F.avg(C("h") / C("n")), 6).alias("depth"))


def a16_evidence_distance(spark, f):
    o = R.set_overlap(D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("pmid")).distinct(), "task", "pmid")
    return o.select("a", "b", F.round(1 - C("jaccard"), 6).alias("distance"))


def a29_budget_audit(spark, f):
    d = D.draws(spark, f, "system", "finish_reason", "n_prompt_tokens", "wall_ms", "error")
    rules = [("prompt_over_200", C("n_prompt_tokens") > 200), ("slow", C("wall_ms") > 60000), ("no_reason", C("finish_reason").isNull()), ("failed", C("error").isNotNull())]
    return d.groupBy("system").agg(*[F.count_if(c).alias(n) for n, c in rules], F.count(F.lit(1)).alias("calls"))


def a33_effective_budget(spark, f):
    cap = table(spark, f, "pack_caps").agg(F.max("capacity_chars")).first()[0]
    n = D.claims(spark, f, "text").groupBy("task").agg(F.sum(F.length("text")).alias("chars"))
    return n.select("task", F.least(F.coalesce("chars", F.lit(0)), F.lit(cap).cast("long")).alias("effective"))


def a35_peer_rows(spark, f):
    """How alike the sets of section titles of tasks of one cutoff are, by a shared title."""
    t = D.tasks(spark, f).where("cutoff is not null").select("task", "cutoff")
    s = D.sections(spark, f, "title").select("task", T.heading(C("title")).alias("h")).where("h <> '' and length(h) > 20").distinct()
    return R.set_overlap(s, "task", "h").join(t.select(C("task").alias("a"), "cutoff"), "a").join(t.select(C("task").alias("b"), "cutoff"), ["b", "cutoff"]).select("a", "b", "common")


def w11_outline_from_markdown(spark, f):
    """Headings of documents with the nearest earlier heading of a lower level as parent."""
    d = latest(table(spark, f, "documents").select("doc_id", "text", "loaded_at"), ["doc_id"]).where("text is not null")
    h = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).where(C("line").rlike("^#{1,6} ")).select("doc_id", "k", F.length(F.regexp_extract("line", "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", "^#+ +", "")).alias("title"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.greatest(*[F.when(C("level") > lv, F.max(F.when(C("level") == lv, C("k"))).over(w)) for lv in range(1, 6)])
    return h.withColumn("parent", parent)


def d08_fairness(spark, f):
    n = table(spark, f, "nation").select("n_nationkey", "n_regionkey", F.when(C("n_nationkey") % 6 == 0, None).otherwise(C("n_nationkey") % 3).alias("provenance"))
    a, b = n.select(C("n_nationkey").alias("a"), C("n_regionkey").alias("ra"), C("provenance").alias("pa")), n.select(C("n_nationkey").alias("b"), C("n_regionkey").alias("rb"), C("provenance").alias("pb"))
    regime = F.when(C("ra") != C("rb"), "cross_model").when(C("pa").isNull() | C("pb").isNull(), "provenance").otherwise("admissible")
    return a.join(b, C("a") < C("b")).groupBy(regime.alias("regime")).agg(F.count(F.lit(1)).alias("pairs"))  # arms are few


def d18_nuisance(spark, f):
    """Radius of a score from the slope, the tolerances of both ends and the number of shifted readouts."""
    tol = ST.S.tolerances(ST._peers(spark, f)).agg(F.percentile("eps", F.lit(0.95)).alias("xi"))
    s = D.scores(spark, f).groupBy("system").agg(F.stddev_pop("z").alias("e"))
    a, b = s.select(C("system").alias("a"), C("e").alias("ea")), s.select(C("system").alias("b"), C("e").alias("eb"))
    return a.join(b, C("a") < C("b")).crossJoin(F.broadcast(tol)).select("a", "b", F.round(0.5 * (C("ea") + C("eb")) + C("xi") * 2, 6).alias("radius"))  # systems are few


def d22_entry_mismatch(spark, f):
    """Mean gap between two systems on the tasks they share, per cluster."""
    s = D.scores(spark, f)
    x, y = s.select("task", "cluster", C("system").alias("a"), C("z").alias("za")), s.select("task", C("system").alias("b"), C("z").alias("zb"))
    return x.join(y, "task").where("a < b").groupBy("a", "b", "cluster").agg(F.round(F.avg(F.abs(C("za") - C("zb"))), 6).alias("gap"), F.count(F.lit(1)).alias("n"))


def d23_radius(spark, f):
    s = D.scores(spark, f)
    x, y = s.select("task", "cluster", C("system").alias("a"), C("z").alias("za")), s.select("task", C("system").alias("b"), C("z").alias("zb"))
    g = x.join(y, "task").where("a < b").groupBy("a", "b", "cluster").agg(F.avg(F.abs(C("za") - C("zb"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 5").groupBy("a", "b").agg(F.round(F.min("gap"), 6).alias("lo"), F.round(F.max("gap"), 6).alias("hi"), F.round(0.5 * F.avg("gap") + 0.5 * F.max("gap"), 6).alias("radius"))


def d24_label_metric(spark, f):
    """Mean distance of consecutive labels of a run: 0 if equal, half if only the kind differs, else 1."""
    log = RO._log(spark, f).withColumn("big", C("n") >= 50)
    w = Window.partitionBy("run").orderBy("ts", "seq")
    p = log.select("run", "kind", "big", F.lag("kind").over(w).alias("pk"), F.lag("big").over(w).alias("pb")).where("pk is not null")
    dist = F.when((C("kind") == C("pk")) & C("big").eqNullSafe(C("pb")), 0.0).when(C("big").eqNullSafe(C("pb")), 0.5).otherwise(1.0)
    return p.groupBy("run").agg(F.round(F.avg(dist), 6).alias("distance"), F.count(F.lit(1)).alias("n"))


def d25_controllability(spark, f):
    """Distance of the first two states of two groups of runs at the fixed point, over five kinds of events."""
    log = RO._log(spark, f)
    nxt = F.lead("kind").over(Window.partitionBy("run").orderBy("ts", "seq"))
    t = log.select((C("run") % 2).alias("g"), "kind", nxt.alias("next")).where("next is not null").groupBy("g", "kind", "next").agg(F.count(F.lit(1)).alias("n"))
    kinds = ["failure", "llm", "open", "search", "validate"]
    cells = {(r["g"], r["kind"], r["next"]): r["n"] for r in t.collect()}  # at most 2 x 5 x 5 rows
    m = np.array([[[cells.get((g, a, b), 0) + 1e-9 for b in kinds] for a in kinds] for g in (0, 1)], dtype=float)
    m /= m.sum(axis=2, keepdims=True)
    d, rounds = AL.fixed_point(m[0], m[1], 1.0 - np.eye(5))
    rows = [(a, b, round(float(d[i, j]), 4)) for i, a in enumerate(kinds) for j, b in enumerate(kinds)]
    return spark.createDataFrame(rows, "a string, b string, distance double").withColumn("rounds", F.lit(rounds))


def d27_envelope(spark, f):
    """Largest and smallest mean over clusters with each cluster left out once, and their product bound."""
    s = D.scores(spark, f).groupBy("system", "cluster").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    tot = s.groupBy("system").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    loo = s.join(tot, "system").select("system", ((C("all_s") - C("s")) / (C("all_n") - C("n"))).alias("m"))
    return loo.groupBy("system").agg(F.round(F.min("m"), 6).alias("lo"), F.round(F.max("m"), 6).alias("hi"), F.round(F.exp(F.sum(F.ln(1 + C("m") / 100))), 6).alias("bound"))


def d28_synthetic_chains(spark, f):
    """Events kept with probability 0.8 by a hash: the share kept must lie near it in every run."""
    keep = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("keep"), "event_id")), 1, 4), 16, 10).cast("int") < 52429
    return table(spark, f, "events").groupBy("user_id").agg(F.count_if(keep).alias("kept"), F.count(F.lit(1)).alias("n"))


def d31_saturation(spark, f):
    v = ST._values(spark, f).where("value is not null")
    return v.groupBy("readout").agg(F.round(F.avg((C("value") >= 0.99).cast("int")), 6).alias("at_top"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


def d32_cells(spark, f):
    v = ST._values(spark, f).where("value is not null")
    a, b = v.select(C("system").alias("a"), "task", "readout", C("value").alias("x")), v.select(C("system").alias("b"), "task", "readout", C("value").alias("y"))
    return a.join(b, ["task", "readout"]).where("a < b").groupBy("a", "b", "readout").agg(F.round(F.avg(C("x") - C("y")), 6).alias("diff"), F.count(F.lit(1)).alias("n"))


def r03_leftover(spark, f):
    """Lines of a task's documents that no claim says word for word."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    docs = latest(table(spark, f, "documents").select("doc_id", "task", "text", "loaded_at"), ["doc_id"]).where("task is not null and text is not null")
    lines = docs.select("task", F.explode(F.split("text", "\n")).alias("line")).select("task", norm("line").alias("n")).where("length(n) >= 20").distinct()
    said = D.claims(spark, f, "text").where("text is not null").select("task", norm("text").alias("n")).distinct()
    return lines.join(said, ["task", "n"], "left_anti").groupBy("task").agg(F.count(F.lit(1)).alias("lines"))


def r10_task_inputs(spark, f):
    n = D.claims(spark, f, "text").groupBy("task").agg(F.count(F.lit(1)).alias("claims"), F.sum(T.blank_count(C("text"))).alias("words"))
    return D.tasks(spark, f).join(n, "task", "left").select("task", "review_pmid", (C("cutoff") - 1).alias("last_year"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("words", F.lit(0)).alias("words"))


def r12_unassigned(spark, f):
    """Claims whose section does not exist, and paragraphs that stand in more than one section."""
    s = D.sections(spark, f, "title").select("task", C("id").alias("section_id"))
    c = D.claims(spark, f, "section_id", "paragraph_id")
    lost = c.where("section_id is not null").join(s, ["task", "section_id"], "left_anti").groupBy("task").agg(F.count(F.lit(1)).alias("lost"))
    double = c.where("paragraph_id is not null and section_id is not null").groupBy("task", "paragraph_id").agg(F.countDistinct("section_id").alias("k")).where("k > 1").groupBy("task").agg(F.count(F.lit(1)).alias("doubled"))
    return D.tasks(spark, f).select("task").join(lost, "task", "left").join(double, "task", "left").select("task", F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("doubled", F.lit(0)).alias("doubled"))


def r14_overlay(spark, f):
    d = D.draws(spark, f, "task", "system", "n_completion_tokens", "error").groupBy("task", "system").agg(F.sum(F.coalesce("n_completion_tokens", F.lit(0))).alias("used"), F.count_if(C("error").isNotNull()).alias("errors"))
    rule = F.when(C("errors") > 3, "discard").when(C("used") > 300, "stop").when(C("errors") > 0, "repeat").otherwise("keep")
    return d.groupBy("system", rule.alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_CL = D.with_sql("claim")
_DOC = "doc AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"
_OVER = f"{_CL}, s AS (SELECT DISTINCT task, unnest(pmids) AS pmid FROM claim), z AS (SELECT task, count(*) AS n FROM s GROUP BY task), c AS (SELECT a.task AS a, b.task AS b, count(*) AS common FROM s a JOIN s b ON a.pmid = b.pmid AND a.task < b.task GROUP BY ALL), ov AS (SELECT a, b, common, common / (x.n + y.n - common) AS jaccard FROM c JOIN z x ON x.task = a JOIN z y ON y.task = b)"
_GAPS = f"{D.with_sql('score')}, g AS (SELECT x.system AS a, y.system AS b, x.cluster, avg(abs(x.z - y.z)) AS gap, count(*) AS n FROM score x JOIN score y ON x.task = y.task AND x.system < y.system GROUP BY ALL)"
_VALUES = "v AS (SELECT c_mktsegment AS system, c_nationkey AS task, o_orderpriority AS readout, max(o_totalprice) / 500000 AS val FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 7 <> 0 GROUP BY 1, 2, 3)"
_NORM = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"

ORACLE = {
    "s09_search_log": f"{D.with_sql('draw')} SELECT draw_id, len(regexp_extract_all(coalesce(completion, ''), '[0-9]{{9}}')) AS n_returned, list_max(regexp_extract_all(coalesce(completion, ''), '[0-9]{{9}}')) AS last FROM draw WHERE stage = 'search'",
    "s15_docstore": f"{D.with_sql('corpus')} SELECT pmid, title, year, n_citation FROM corpus",
    "s19_flat_index": "SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS square FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL",
    "s22_score_table": f"{D.with_sql('score')} SELECT system, cluster, round(avg(z), 6) AS value, count(*) AS n_units FROM score GROUP BY 1, 2",
    "t31_marker_spans": rf"{D.with_sql('corpus')}, p AS (SELECT pmid, regexp_split_to_array(abstract, '\[\s*\d[\d,;\s–-]*\]') AS g, regexp_extract_all(abstract, '\[\s*\d[\d,;\s–-]*\]') AS m FROM corpus WHERE abstract IS NOT NULL), r AS (SELECT pmid, unnest(range(len(m)))::INT AS k, g, m FROM p), s AS (SELECT pmid, k, m[k + 1] AS mark, list_sum(list_transform(g[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0) AS start FROM r) SELECT pmid, k, start, start + length(mark) AS end_ FROM s",
    "v01_id_space": f"{D.with_sql('vector')} SELECT count(*) AS rows, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, count(*) - count(DISTINCT id) AS duplicates FROM vector",
    "v05_visible_nearest": f"{D.with_sql('vector')}, v AS (SELECT id, year, embedding::DOUBLE[] AS e FROM vector), s AS (SELECT q.id AS qid, v.id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.id % 100 = 0 AND v.year IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM s) SELECT qid, id, score FROM r WHERE rn <= 5",
    "v10_outermost": "WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) - 1 AS depth FROM events) SELECT run, count(*) FILTER (depth = 0) AS outermost, max(depth) AS deepest FROM e GROUP BY run",
    "v12_row_allowlist": f"{D.with_sql('corpus', 'task')}, r AS (SELECT pmid, pmid % 16 AS shard, row_number() OVER (PARTITION BY pmid % 16 ORDER BY pmid) AS row FROM corpus), l AS (SELECT task, review_pmid, CAST(unnest(list_distinct(tail)) AS BIGINT) AS pmid FROM task) SELECT task, count(*) AS n, min((shard, row))[1] AS shard, min((shard, row))[2] AS row FROM l JOIN r USING (pmid) WHERE pmid IS DISTINCT FROM review_pmid GROUP BY task",
    "j28_title_map": f"{_CL}, z AS (SELECT task, unnest(ref_nos) AS n, unnest(pmids) AS pmid FROM claim WHERE len(pmids) > 0) SELECT task, n, min(pmid) AS title FROM z WHERE n IS NOT NULL AND pmid IS NOT NULL GROUP BY task, n",
    "a02_community_breadth": f"{_CL}, {_DOC}, g AS (SELECT DISTINCT task, pmid FROM doc WHERE task IS NOT NULL AND pmid IS NOT NULL), c AS (SELECT DISTINCT task, section_type, unnest(pmids) AS pmid FROM claim WHERE section_type IS NOT NULL), j AS (SELECT c.task, section_type, count(g.pmid) AS h, count(*) AS n FROM c LEFT JOIN g ON g.task = c.task AND g.pmid = c.pmid GROUP BY 1, 2) SELECT task, round(avg(CAST(h > 0 AS INT)), 6) AS breadth, round(avg(h / n), 6) AS depth FROM j GROUP BY task",
    "a16_evidence_distance": f"{_OVER} SELECT a, b, round(1 - jaccard, 6) AS distance FROM ov",
    "a29_budget_audit": f"{D.with_sql('draw')} SELECT system, count(*) FILTER (n_prompt_tokens > 200) AS prompt_over_200, count(*) FILTER (wall_ms > 60000) AS slow, count(*) FILTER (finish_reason IS NULL) AS no_reason, count(error) AS failed, count(*) AS calls FROM draw GROUP BY system",
    "a33_effective_budget": f"{_CL} SELECT task, least(coalesce(sum(length(text)), 0), (SELECT max(capacity_chars) FROM pack_caps)) AS effective FROM claim GROUP BY task",
    "a35_peer_rows": rf"{D.with_sql('section', 'task')}, s AS (SELECT DISTINCT task, regexp_replace(regexp_replace(regexp_replace(lower(title), '^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+', ''), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g') AS h FROM section WHERE title IS NOT NULL), c AS (SELECT a.task AS a, b.task AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.task < b.task WHERE length(a.h) > 20 GROUP BY 1, 2) SELECT a, b, common FROM c JOIN task x ON x.task = a JOIN task y ON y.task = b AND x.cutoff = y.cutoff",
    "w11_outline_from_markdown": rf"WITH {_DOC}, l AS (SELECT doc_id, unnest(range(len(x)))::INT AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM doc WHERE text IS NOT NULL)), h AS (SELECT doc_id, k, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+ +', '')) AS title FROM l WHERE regexp_matches(line, '^#{{1,6}} ')) SELECT a.doc_id, a.k, a.level, a.title, max(b.k) AS parent FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.k < a.k AND b.level < a.level GROUP BY ALL",
    "d08_fairness": "WITH n AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey % 3 END AS p FROM nation) SELECT CASE WHEN a.n_regionkey <> b.n_regionkey THEN 'cross_model' WHEN a.p IS NULL OR b.p IS NULL THEN 'provenance' ELSE 'admissible' END AS regime, count(*) AS pairs FROM n a JOIN n b ON a.n_nationkey < b.n_nationkey GROUP BY 1",
    "d18_nuisance": f"WITH {ST._PEERS}, {D.SQL['score']}, gp AS (SELECT p.readout, abs(p.value - s.value) AS gap FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self), t AS (SELECT quantile_cont(eps, 0.95) AS xi FROM (SELECT readout, quantile_cont(gap, 0.5) AS eps FROM gp GROUP BY readout)), s AS (SELECT system, stddev_pop(z) AS e FROM score GROUP BY system) SELECT a.system AS a, b.system AS b, round(0.5 * (a.e + b.e) + xi * 2, 6) AS radius FROM s a JOIN s b ON a.system < b.system, t",
    "d22_entry_mismatch": f"{_GAPS} SELECT a, b, cluster, round(gap, 6) AS gap, n FROM g",
    "d23_radius": f"{_GAPS} SELECT a, b, round(min(gap), 6) AS lo, round(max(gap), 6) AS hi, round(0.5 * avg(gap) + 0.5 * max(gap), 6) AS radius FROM g WHERE n >= 5 GROUP BY a, b",
    "d24_label_metric": f"WITH {RO._LOG}, x AS (SELECT log.*, CAST(json_extract(props, '$.k') AS INT) >= 50 AS big FROM log JOIN events ON event_id = seq), p AS (SELECT run, kind, big, lag(kind) OVER w AS pk, lag(big) OVER w AS pb FROM x WINDOW w AS (PARTITION BY run ORDER BY ts, seq)) SELECT run, round(avg(CASE WHEN kind = pk AND big IS NOT DISTINCT FROM pb THEN 0.0 WHEN big IS NOT DISTINCT FROM pb THEN 0.5 ELSE 1.0 END), 6) AS distance, count(*) AS n FROM p WHERE pk IS NOT NULL GROUP BY run",
    "d27_envelope": f"{D.with_sql('score')}, s AS (SELECT system, cluster, sum(z) AS s, count(*) AS n FROM score GROUP BY ALL), t AS (SELECT system, sum(s) AS ts, sum(n) AS tn FROM s GROUP BY system), l AS (SELECT system, (ts - s) / (tn - n) AS m FROM s JOIN t USING (system)) SELECT system, round(min(m), 6) AS lo, round(max(m), 6) AS hi, round(exp(sum(ln(1 + m / 100))), 6) AS bound FROM l GROUP BY system",
    "d28_synthetic_chains": "SELECT user_id, count(*) FILTER (CAST('0x' || md5('keep:' || event_id)[1:4] AS INT) < 52429) AS kept, count(*) AS n FROM events GROUP BY user_id",
    "d31_saturation": f"WITH {_VALUES} SELECT readout, round(avg(CAST(val >= 0.99 AS INT)), 6) AS at_top, round(quantile_cont(val, 0.5), 6) AS median FROM v GROUP BY readout",
    "d32_cells": f"WITH {_VALUES} SELECT x.system AS a, y.system AS b, x.readout, round(avg(x.val - y.val), 6) AS diff, count(*) AS n FROM v x JOIN v y ON x.task = y.task AND x.readout = y.readout AND x.system < y.system GROUP BY 1, 2, 3",
    "r03_leftover": f"{_CL}, {_DOC}, l AS (SELECT DISTINCT task, {_NORM('line')} AS n FROM (SELECT task, unnest(string_split(text, chr(10))) AS line FROM doc WHERE task IS NOT NULL AND text IS NOT NULL)), c AS (SELECT DISTINCT task, {_NORM('text')} AS n FROM claim WHERE text IS NOT NULL) SELECT task, count(*) AS lines FROM (SELECT * FROM l WHERE length(n) >= 20) ANTI JOIN c USING (task, n) GROUP BY task",
    "r10_task_inputs": rf"{D.with_sql('claim', 'task')}, n AS (SELECT task, count(*) AS claims, sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))) AS words FROM claim GROUP BY task) SELECT task, review_pmid, cutoff - 1 AS last_year, coalesce(claims, 0) AS claims, coalesce(words, 0) AS words FROM task LEFT JOIN n USING (task)",
    "r12_unassigned": f"{D.with_sql('claim', 'section', 'task')}, l AS (SELECT task, count(*) AS lost FROM claim c WHERE section_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM section s WHERE s.task = c.task AND s.id = c.section_id) GROUP BY task), d AS (SELECT task, count(*) AS doubled FROM (SELECT task, paragraph_id FROM claim WHERE paragraph_id IS NOT NULL AND section_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT section_id) > 1) GROUP BY task) SELECT task.task, coalesce(lost, 0) AS lost, coalesce(doubled, 0) AS doubled FROM task LEFT JOIN l USING (task) LEFT JOIN d USING (task)",
    "r14_overlay": f"{D.with_sql('draw')}, d AS (SELECT task, system, sum(coalesce(n_completion_tokens, 0)) AS used, count(error) AS errors FROM draw GROUP BY ALL) SELECT system, CASE WHEN errors > 3 THEN 'discard' WHEN used > 300 THEN 'stop' WHEN errors > 0 THEN 'repeat' ELSE 'keep' END AS decision, count(*) AS n FROM d GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "j16_alignment", "j17_relocation", "d25_controllability", "t03_term_hash"]}
