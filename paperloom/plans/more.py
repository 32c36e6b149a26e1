"""Queries of small exports, ledgers and replays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import matching as M
from paperloom.operators.lexical import B, K1, MAX_DF_FRACTION, MIN_DF
from paperloom.plans import readouts as RO
from paperloom.plans import runs as RU
from paperloom.plans import stats as ST
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col


def s04_edge_export(spark, f):
    """Each claim's cited papers as one list; claims that cite none are left out."""
    return D.claims(spark, f, "pmids").where("size(pmids) > 0").select("id", F.array_join("pmids", " ").alias("refs"), F.size("pmids").alias("n"))


def s10_tap_routes(spark, f):
    e = table(spark, f, "events")
    return e.groupBy(F.concat(F.lit("tap:"), "event_type", F.lit("."), F.when(C("value") > 10, "long").otherwise("short")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def s18_first_record(spark, f):
    """Of every paper delivered, the record that came first."""
    from paperloom.operators.ranking import first_wins

    raw = table(spark, f, "papers").select("pmid", "faiss_id", "loaded_at", F.length("abs").alias("n_chars"))
    return first_wins(raw, ["pmid"], [C("loaded_at"), C("faiss_id")]).select("pmid", "n_chars")


def l06_fingerprint(spark, f):
    """What decides whether an index is built again: parameters and size of the corpus in one digest."""
    n = D.corpus(spark, f, "title").agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.substring(F.sha2(F.concat(F.lit(f"k1={K1};b={B};max={MAX_DF_FRACTION};min={MIN_DF};n="), "n"), 256), 1, 16).alias("fingerprint"))


def j02_shards(spark, f):
    p = D.corpus(spark, f, "abstract")
    return p.groupBy((C("pmid") % 64).alias("shard")).agg(F.count(F.lit(1)).alias("keys"), F.min("pmid").alias("first"), F.sum(F.length("abstract")).alias("chars"))


def a17_outline_distance(spark, f):
    """0.5 x unmatched headings + 0.2 x gap in size + 0.3 x headings not shared at all."""
    f1 = RU.a19_title_f1(spark, f)
    ours = latest(table(spark, f, "outline_nodes"), ["system", "task", "id"]).groupBy("system", "task").agg(F.count(F.lit(1)).alias("no"))
    theirs = D.sections(spark, f, "title").groupBy("task").agg(F.count(F.lit(1)).alias("nt"))
    size = F.least(F.lit(1.0), F.abs(F.ln(C("no") / C("nt"))))
    return f1.join(ours, ["system", "task"]).join(theirs, "task").select("system", "task", F.round(0.5 * (1 - C("f1")) + 0.2 * size + 0.3 * (C("f1") == 0).cast("int"), 6).alias("distance"))


def w19_ledger(spark, f):
    """A run's searches against its quota: which are allowed, and how many are refused."""
    log = RO._log(spark, f).where("kind = 'search'")
    used = F.row_number().over(Window.partitionBy("run").orderBy("ts", "seq"))
    return log.withColumn("used", used).groupBy("run").agg(F.count_if(C("used") <= 20).alias("allowed"), F.count_if(C("used") > 20).alias("refused"), F.min(F.when(C("used") > 20, C("seq"))).alias("first_refused"))


def d20_designs(spark, f):
    """Three ways to put a bound on how fast a readout moves, side by side."""
    p = ST._peers(spark, f)
    own = p.where("is_self").select("task", "readout", C("value").alias("own"), C("source").alias("me"))
    r = p.where("not is_self").join(own, ["task", "readout"]).withColumn("ratio", F.abs(C("value") - C("own")) / (F.abs(C("source") - C("me")) / 1000 + 0.01))
    g = r.groupBy("readout").agg(F.percentile("ratio", F.lit(0.95)).alias("q95"), F.max("ratio").alias("max"), F.avg("ratio").alias("mean"))
    return g.unpivot("readout", ["q95", "max", "mean"], "design", "bound").select("readout", "design", F.round("bound", 6).alias("bound"))


def r01_views(spark, f):
    """The planning view of a run keeps what came before its first writing call."""
    d = D.draws(spark, f, "task", "system", "stage", "t_req")
    first = d.where("stage = 'write'").groupBy("task", "system").agg(F.min("t_req").alias("cut"))
    j = d.join(first, ["task", "system"], "left")
    view = F.when(C("cut").isNull() | (C("t_req") < C("cut")), "planning").otherwise("synthesis")
    return j.groupBy("system", view.alias("view")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("task").alias("tasks"))


def r04_rollouts(spark, f):
    """Rollouts put together from calls: their stages in order of first use."""
    d = D.draws(spark, f, "task", "system", "stage", "t_req").where("t_req is not null").groupBy("task", "system", "stage").agg(F.min(F.struct("t_req", "draw_id")).alias("t"), F.count(F.lit(1)).alias("n"))
    return d.groupBy("task", "system").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "stage"))), lambda x: x["stage"]), ">").alias("stages"), F.sum("n").alias("calls"))


def r06_merge_rollouts(spark, f):
    """Rollouts of one system built anew and merged over the old ones."""
    old = D.draws(spark, f, "task", "system", "error").groupBy("task", "system").agg(F.count(F.lit(1)).alias("calls"))
    new = D.draws(spark, f, "task", "system", "error").where("error is null").groupBy("task", "system").agg(F.count(F.lit(1)).alias("calls"))
    return M.upsert(old, new, ["task", "system"])


def r13_acquisition_prefix(spark, f):
    """How many events of a run come before its first writing event, and whether they are a clean prefix."""
    log = RO._log(spark, f)
    first = log.where("kind = 'llm'").groupBy("run").agg(F.min(F.struct("ts", "seq")).alias("cut"))
    j = log.join(first, "run")
    early = F.struct("ts", "seq") < C("cut")
    return j.groupBy("run").agg(F.count_if(early).alias("prefix"), F.count_if(~early & (C("kind") == "search")).alias("late_searches"))


def r16_peer_band(spark, f):
    """The band of agreement of other systems' outlines, per task."""
    f1 = RU.a19_title_f1(spark, f)
    q = F.percentile("f1", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return f1.groupBy("task").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).select("task", F.round(C("q")[0], 6).alias("lo"), F.round(C("q")[1], 6).alias("median"), F.round(C("q")[2], 6).alias("hi"), "n")


def r17_replay(spark, f):
    """Two orders of a journal's papers, replayed place by place: how many places agree."""
    p = D.corpus(spark, f, "year", "n_citation", "journal").where("journal is not null").select("journal", "pmid", F.coalesce("n_citation", F.lit(0)).alias("c"), "year")
    one = F.row_number().over(Window.partitionBy("journal").orderBy(C("c").desc(), "pmid"))
    two = F.row_number().over(Window.partitionBy("journal").orderBy(C("year").desc_nulls_last(), C("c").desc(), "pmid"))
    return p.withColumns({"a": one, "b": two}).groupBy("journal").agg(F.count_if(C("a") == C("b")).alias("same_place"), F.max(F.abs(C("a") - C("b"))).alias("farthest"), F.count(F.lit(1)).alias("n"))


_OUT = "node AS (SELECT * FROM outline_nodes QUALIFY row_number() OVER (PARTITION BY system, task, id ORDER BY loaded_at DESC) = 1)"
_F1 = RU.ORACLE["a19_title_f1"]

ORACLE = {
    "s04_edge_export": f"{D.with_sql('claim')} SELECT id, array_to_string(pmids, ' ') AS refs, len(pmids) AS n FROM claim WHERE len(pmids) > 0",
    "s10_tap_routes": "SELECT 'tap:' || event_type || '.' || CASE WHEN value > 10 THEN 'long' ELSE 'short' END AS route, count(*) AS n FROM events GROUP BY 1",
    "s18_first_record": "SELECT pmid, length(abs) AS n_chars FROM papers QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY loaded_at, faiss_id) = 1",
    "l06_fingerprint": f"{D.with_sql('corpus')} SELECT count(*) AS n, left(sha256('k1={K1};b={B};max={MAX_DF_FRACTION};min={MIN_DF};n=' || count(*)), 16) AS fingerprint FROM corpus",
    "j02_shards": f"{D.with_sql('corpus')} SELECT pmid % 64 AS shard, count(*) AS keys, min(pmid) AS first, sum(length(abstract)) AS chars FROM corpus GROUP BY 1",
    "a17_outline_distance": f"WITH f AS ({_F1}), {_OUT}, o AS (SELECT system, task, count(*) AS no FROM node GROUP BY ALL), {D.SQL['section']}, t AS (SELECT task, count(*) AS nt FROM section GROUP BY task) SELECT f.system, f.task, round(0.5 * (1 - f1) + 0.2 * least(1.0, abs(ln(no / nt))) + 0.3 * CAST(f1 = 0 AS INT), 6) AS distance FROM f JOIN o ON o.system = f.system AND o.task = f.task JOIN t ON t.task = f.task",
    "w19_ledger": f"WITH {RO._LOG}, u AS (SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS used FROM log WHERE kind = 'search') SELECT run, count(*) FILTER (used <= 20) AS allowed, count(*) FILTER (used > 20) AS refused, min(seq) FILTER (used > 20) AS first_refused FROM u GROUP BY run",
    "d20_designs": f"WITH {ST._PEERS}, r AS (SELECT p.readout, abs(p.value - s.value) / (abs(p.source - s.source) / 1000 + 0.01) AS ratio FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self) SELECT readout, 'q95' AS design, round(quantile_cont(ratio, 0.95), 6) AS bound FROM r GROUP BY readout UNION ALL SELECT readout, 'max', round(max(ratio), 6) FROM r GROUP BY readout UNION ALL SELECT readout, 'mean', round(avg(ratio), 6) FROM r GROUP BY readout",
    "r01_views": f"{D.with_sql('draw')}, c AS (SELECT task, system, min(t_req) AS cut FROM draw WHERE stage = 'write' GROUP BY ALL) SELECT d.system, CASE WHEN cut IS NULL OR t_req < cut THEN 'planning' ELSE 'synthesis' END AS view, count(*) AS calls, count(DISTINCT d.task) AS tasks FROM draw d LEFT JOIN c ON c.task = d.task AND c.system = d.system GROUP BY 1, 2",
    "r04_rollouts": f"{D.with_sql('draw')}, s AS (SELECT task, system, stage, min((t_req, draw_id)) AS t, count(*) AS n FROM draw WHERE t_req IS NOT NULL GROUP BY ALL) SELECT task, system, string_agg(stage, '>' ORDER BY t) AS stages, sum(n) AS calls FROM s GROUP BY task, system",
    "r06_merge_rollouts": f"{D.with_sql('draw')} SELECT task, system, CASE WHEN count(*) FILTER (error IS NULL) > 0 THEN count(*) FILTER (error IS NULL) ELSE count(*) END AS calls FROM draw GROUP BY ALL",
    "r13_acquisition_prefix": f"WITH {RO._LOG}, c AS (SELECT run, min((ts, seq)) AS cut FROM log WHERE kind = 'llm' GROUP BY run) SELECT run, count(*) FILTER ((ts, seq) < cut) AS prefix, count(*) FILTER (NOT (ts, seq) < cut AND kind = 'search') AS late_searches FROM log JOIN c USING (run) GROUP BY run",
    "r16_peer_band": f"WITH f AS ({_F1}) SELECT task, round(quantile_cont(f1, 0.1), 6) AS lo, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.9), 6) AS hi, count(*) AS n FROM f GROUP BY task",
    "r17_replay": f"{D.with_sql('corpus')}, p AS (SELECT journal, row_number() OVER (PARTITION BY journal ORDER BY coalesce(n_citation, 0) DESC, pmid) AS a, row_number() OVER (PARTITION BY journal ORDER BY year DESC NULLS LAST, coalesce(n_citation, 0) DESC, pmid) AS b FROM corpus WHERE journal IS NOT NULL) SELECT journal, count(*) FILTER (a = b) AS same_place, max(abs(a - b)) AS farthest, count(*) AS n FROM p GROUP BY journal",
}
QUERIES = {n: globals()[n] for n in ORACLE}
