"""Queries of readouts, budgets, splits and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.operators import ranking as K
from paperloom.operators import readouts as R
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col


def _given(spark, f):
    """The evidence a task was given: the papers of its documents."""
    return latest(table(spark, f, "documents").select("doc_id", "task", "pmid", "loaded_at"), ["doc_id"]).where("task is not null and pmid is not null").select("task", "pmid").distinct()


def a01_weighted_recall(spark, f):
    members = R.strata(R.citation_weights(D.claims(spark, f, "pmids")), 0.75)
    return R.weighted_recall(members, _given(spark, f)).select("task", "stratum", F.round("recall", 6).alias("recall"), "n")


def a04_claim_coverage(spark, f):
    given = _given(spark, f).groupBy("task").agg(F.collect_set("pmid").alias("given"))
    c = D.claims(spark, f, "pmids", "tier").join(given, "task", "left").withColumn("match", F.coalesce(F.arrays_overlap("pmids", "given"), F.lit(False)).cast("int"))
    return c.groupBy("task", "tier").agg(F.round(F.avg("match"), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


def a05_integration(spark, f):
    return D.claims(spark, f, "pmids").groupBy("task").agg(F.round(F.avg((F.size(F.array_distinct("pmids")) >= 2).cast("int")), 6).alias("multi_source"), F.count(F.lit(1)).alias("n"))


def a05_paper_reuse(spark, f):
    used = D.claims(spark, f, "pmids").select("task", "id", F.explode(F.array_distinct("pmids")).alias("pmid")).groupBy("task", "pmid").agg(F.countDistinct("id").alias("claims"))
    return used.groupBy("task").agg(F.count_if(C("claims") >= 2).alias("reused"), F.count(F.lit(1)).alias("papers"))


def a07_order_concordance(spark, f):
    """Of the pairs of a task's sections of one level, the share whose titles stand in the order of their ids."""
    s = D.sections(spark, f, "title", "parent").where("title is not null and (parent is null or parent = '')").select("task", "id", "title")
    a, b = s.select("task", C("id").alias("i"), C("title").alias("t")), s.select("task", C("id").alias("j"), C("title").alias("u"))
    pairs = a.join(b, "task").where("i < j and t <> u")
    return pairs.groupBy("task").agg(F.round(F.avg((C("t") < C("u")).cast("int")), 6).alias("concordance"), F.count(F.lit(1)).alias("pairs"))


def a07_size_fit(spark, f):
    n = D.claims(spark, f, "text").groupBy("task").agg(F.count(F.lit(1)).alias("got"))
    fit = 1 - F.least(F.lit(1.0), F.abs(F.ln(C("got") / C("n_claims"))))
    return D.tasks(spark, f).join(n, "task").where("n_claims > 0").select("task", F.round(fit, 6).alias("size_fit"))


def a09_claims_per_paper(spark, f):
    c = D.claims(spark, f, "section_id").groupBy("task").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("section_id").alias("sections"))
    p = R.citation_weights(D.claims(spark, f, "pmids")).groupBy("task").agg(F.count(F.lit(1)).alias("papers"))
    r = R.ratio(C("claims"), C("papers"))
    return c.join(p, "task", "left").select("task", F.round(r / (1 + r), 6).alias("density"), "sections")


def a10_completion(spark, f):
    d = D.draws(spark, f, "task", "system", "completion", "finish_reason", "error")
    return d.groupBy("task", "system").agg(F.max(F.when((C("finish_reason") == "stop") & C("error").isNull(), 1.0).otherwise(0.0)).alias("completion"))


def a11_claim_tiers(spark, f):
    return R.claim_tiers(D.claims(spark, f, "weight", "groundedness", "contradict")).groupBy("task", "tier").agg(F.count(F.lit(1)).alias("n"))


def a12_strata(spark, f):
    return R.strata(R.citation_weights(D.claims(spark, f, "pmids")), 0.75).groupBy("task", "stratum").agg(F.count(F.lit(1)).alias("papers"), F.sum("weight").alias("weight"))


def a12_central_claims(spark, f):
    c = D.claims(spark, f, "paragraph_id", "weight").where("paragraph_id is not null and weight is not null")
    return c.groupBy("task", "paragraph_id").agg(F.min_by("id", F.struct(-C("weight"), C("id"))).alias("central"))


def a13_section_distance(spark, f):
    tops = D.sections(spark, f, "parent").where("parent is null or parent = ''").select("task", "id")
    ord_ = tops.withColumn("o", F.row_number().over(Window.partitionBy("task").orderBy("id")))
    c = D.claims(spark, f, "section_id").join(ord_.withColumnRenamed("id", "section_id"), ["task", "section_id"], "left").select("id", "task", "o")
    e = table(spark, f, "units").select("task", F.explode("restatements").alias("r")).select(C("r.source_id").alias("s"), C("r.target_id").alias("t"))
    j = e.join(c.select(C("id").alias("s"), C("o").alias("os")), "s").join(c.select(C("id").alias("t"), C("o").alias("ot")), "t")
    d = F.abs(C("os") - C("ot"))
    kind = F.when(d.isNull(), "unknown").when(d == 0, "within").when(d == 1, "adjacent").otherwise("distant")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def a14_grounding(spark, f):
    g = F.when(C("groundedness") >= 0.5, "entailment").when(C("contradict") >= 0.5, "contradiction").when(C("groundedness").isNull(), "ungrounded").otherwise("neutral")
    return D.claims(spark, f, "ref_nos", "groundedness", "contradict").groupBy("task", g.alias("label")).agg(F.count(F.lit(1)).alias("claims"), F.sum(F.size("ref_nos")).alias("refs"))


def a15_evidence_jaccard(spark, f):
    sets = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("pmid")).distinct()
    return R.set_overlap(sets, "task", "pmid").select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


def a18_citation_profile(spark, f):
    rows = D.claims(spark, f, "section_type").where("section_type is not null").select("task", "section_type")
    return R.profile(rows, "task", "section_type").select("task", "section_type", F.round("share", 6).alias("share"))


def a20_allocation(spark, f):
    """Papers placed by the claims' sections (human) and by their own journals (system)."""
    human = D.claims(spark, f, "section_type", "pmids").where("section_type is not null").select("task", "section_type", F.explode("pmids").alias("pmid")).groupBy("task", "pmid").agg(F.min("section_type").alias("human"))
    system = D.corpus(spark, f, "journal").select(C("pmid").cast("string").alias("pmid"), F.coalesce("journal", F.lit("none")).alias("system"))
    return R.pair_agreement(human.join(system, "pmid")).select("task", "tp", "fp", "fn", "tn", F.round("rand", 6).alias("rand"), F.round("ari", 6).alias("ari"))


def a21_allocation_extract(spark, f):
    rows = D.claims(spark, f, "section_id", "pmids").where("section_id is not null").select("task", "section_id", F.explode("pmids").alias("pmid"))
    return rows.groupBy("task", "section_id").agg(F.array_sort(F.collect_set("pmid")).alias("pmids"))


def a24_budget_caps(spark, f):
    """Per hour of the log and event kind: the greatest count over runs, ties to the later run."""
    e = table(spark, f, "events").groupBy(C("user_id").alias("arm"), F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("day", "event_type").agg(F.max(F.struct("n", "arm")).alias("m")).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", C("m.n").alias("cap"), C("m.arm").alias("arm"))


def a25_bundle_cap(spark, f):
    sizes = table(spark, f, "events").groupBy(C("user_id").alias("arm")).agg(F.countDistinct("event_type").alias("n"))
    top = sizes.agg(F.max("n").alias("k"))
    return sizes.crossJoin(F.broadcast(top)).agg(F.least(F.max("k"), F.lit(1000)).alias("k_cap"), F.min(F.when(C("n") == C("k"), C("arm"))).alias("arm"), F.percentile("n", F.lit(0.5)).alias("median"))


def a26_run_resources(spark, f):
    return D.draws(spark, f, "system", "n_prompt_tokens", "wall_ms", "error").groupBy("system").agg(F.round(F.avg("n_prompt_tokens"), 6).alias("prompt_tokens"), F.round(F.avg("wall_ms"), 6).alias("wall_ms"), F.count(F.lit(1)).alias("calls"), F.count("error").alias("errors"))


def a27_family_medians(spark, f):
    per = D.draws(spark, f, "task", "system", "n_completion_tokens").groupBy("system", "task").agg(F.avg("n_completion_tokens").alias("words"))
    return per.groupBy("system").agg(F.round(F.percentile("words", F.lit(0.5)), 6).alias("median_words"), F.count(F.lit(1)).alias("tasks"))


def a31_relative_reward(spark, f):
    s = D.scores(spark, f)
    best = s.groupBy("task").agg(F.max("z").alias("best"))
    gain = F.tanh((C("z") - C("best")) / 0.1)
    return s.join(best, "task").groupBy("system").agg(F.round(F.sum(gain) / F.count(F.lit(1)), 6).alias("reward"))


def a32_word_budget(spark, f):
    n = D.claims(spark, f, "section_id").where("section_id is not null").groupBy("task", "section_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("task").agg(F.sum(1 + C("n")).alias("all_"))
    words = F.greatest(F.lit(250), F.least(F.lit(900), F.bround(6000.0 * (1 + C("n")) / C("all_")).cast("int")))
    return n.join(total, "task").select("task", "section_id", words.alias("words"))


def a34_set_audit(spark, f):
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("pmid")).groupBy("task").agg(F.collect_set("pmid").alias("used"))
    allowed = D.tasks(spark, f).select("task", F.array_distinct(F.concat(F.coalesce("hubs", F.array().cast("array<string>")), F.coalesce("tail", F.array().cast("array<string>")))).alias("allowed"))
    return allowed.join(cited, "task").select("task", F.size(F.array_except("used", "allowed")).alias("not_allowed"), F.size(F.array_except("allowed", "used")).alias("not_used"))


def a36_coverage(spark, f):
    return D.claims(spark, f, "section_type", "groundedness", "contradict").groupBy("task", "section_type").agg(F.count(F.lit(1)).alias("n"), F.count("groundedness").alias("grounded"), F.count("contradict").alias("contradicted"))


def w01_split(spark, f):
    t = D.tasks(spark, f).select("task", (C("cutoff") % 5).alias("topic")).where("topic is not null")
    h = F.sha2(F.concat(F.lit("20260824:"), "task"), 256)
    return K.round_robin(t.withColumn("h", h), ["topic"], [C("h")], ["topic"], 20).select("task", "topic", "round")


def w02_quota(spark, f):
    return K.largest_remainder(table(spark, f, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("w")), "c_nationkey", "w", 50)


def w03_selection(spark, f):
    """Of each journal's papers up to 2024: two-year windows, seats by share, filled by citation count."""
    p = D.corpus(spark, f, "year", "n_citation", "journal").where("journal is not null and year <= 2024").select("journal", "pmid", F.coalesce("n_citation", F.lit(0)).alias("c"), F.floor((2024 - C("year")) / 2).alias("win"))
    per = p.groupBy("journal", "win").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("journal")
    share = C("n") * 30 / F.sum("n").over(w)
    base = per.withColumns({"base": F.floor(share), "frac": F.round(share - F.floor(share), 9)})
    left = F.lit(30) - F.sum("base").over(w)
    seats = base.withColumn("left_", left).withColumn("rn", F.row_number().over(Window.partitionBy("journal").orderBy(C("frac").desc(), "win"))).select("journal", "win", (C("base") + (C("rn") <= C("left_")).cast("int")).alias("seats"))
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy("journal", "win").orderBy(C("c").desc(), "pmid"))).where("r <= 30")
    return ranked.join(seats, ["journal", "win"]).where("r <= seats").select("journal", "win", "pmid", "r")


def w04_first_occurrence(spark, f):
    rows = D.claims(spark, f, "pmids").select("task", "id", F.posexplode("pmids").alias("pos", "pmid"))
    return K.first_wins(rows, ["task", "pmid"], [C("id"), C("pos")]).select("task", "pmid", "id", "pos")


def w06_fusion(spark, f):
    """Two orders of each journal's papers fused by rank over quota, the smaller first, once each."""
    p = D.corpus(spark, f, "year", "n_citation", "journal").where("journal is not null").select("journal", "pmid", "year", F.coalesce("n_citation", F.lit(0)).alias("c"))
    a = p.withColumn("r", F.row_number().over(Window.partitionBy("journal").orderBy(C("c").desc(), "pmid"))).select("journal", "pmid", (C("r") * 2).alias("key"), F.lit(0).alias("list"))
    b = p.withColumn("r", F.row_number().over(Window.partitionBy("journal").orderBy(C("year").desc_nulls_last(), "pmid"))).select("journal", "pmid", (C("r") * 3).alias("key"), F.lit(1).alias("list"))
    best = K.first_wins(a.unionByName(b), ["journal", "pmid"], [C("key"), C("list")])
    return K.top_k(best, ["journal"], [C("key"), C("list"), C("pmid")], 10).select("journal", "pmid", "rank")


def w08_interleave(spark, f):
    rows = D.claims(spark, f, "pmids").select("task", "id", F.posexplode("pmids").alias("depth", "pmid"))
    first = K.first_wins(rows, ["task", "pmid"], [C("depth"), C("id")])
    return K.top_k(first, ["task"], [C("depth"), C("id"), C("pmid")], 12).select("task", "pmid", "rank")


def w09_truncate(spark, f):
    s = D.claims(spark, f, "text", "section_id").where("section_id is not null and text is not null").groupBy("task", "section_id").agg(F.sum(F.length("text")).alias("words"))
    return K.whole_until(s, ["task"], ["section_id"], C("words"), 1500).select("task", "section_id", "words")


def _log(spark, f):
    kind = F.when(C("event_type") == "view", "search").when(C("event_type") == "click", "open").when(C("event_type") == "purchase", "llm").when(C("event_type") == "error", "failure").otherwise("validate")
    return table(spark, f, "events").select(C("user_id").alias("run"), C("event_id").alias("seq"), "ts", kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("n"))


def w14_history(spark, f):
    log = _log(spark, f)
    last = log.where("kind <> 'llm'").groupBy("run").agg(F.max("ts").alias("last"))
    stage = F.when((C("kind") == "llm") & (C("ts") <= C("last")), "acquisition").when(C("kind") == "llm", "writing").otherwise(C("kind"))
    pos = F.row_number().over(Window.partitionBy("run").orderBy("ts", "seq")) - 1
    return log.join(last, "run", "left").select("run", "seq", pos.alias("pos"), stage.alias("stage"))


_EDGES = [1, 5, 20]


def _binned(c):
    out = F.lit(0)
    for e in _EDGES:
        out = out + (c >= e).cast("int")
    return out


def _states(spark, f):
    before = Window.partitionBy("run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy("run").orderBy("ts", "seq")
    n = lambda k: F.coalesce(F.sum((C("kind") == k).cast("int")).over(before), F.lit(0))
    s = _log(spark, f).select("run", "seq", "ts", "kind", F.coalesce(F.lag("kind").over(line), F.lit("start")).alias("stage"), _binned(n("search")).alias("searches"), _binned(n("llm")).alias("calls"))
    return s.withColumn("state", F.concat_ws("/", "stage", "searches", "calls"))


def w16_states(spark, f):
    return _states(spark, f).select("run", "seq", "stage", "searches", "calls")


def w17_kernel(spark, f):
    s = _states(spark, f)
    nxt = F.coalesce(F.lead("state").over(Window.partitionBy("run").orderBy("ts", "seq")), F.lit("terminal"))
    t = s.select("state", "kind", nxt.alias("next")).groupBy("state", "kind", "next").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy("state").agg(F.sum("n").alias("all_"))
    return t.join(total, "state").select("state", "kind", "next", "n", F.round(C("n") / C("all_"), 6).alias("p"))


def w18_waves(spark, f):
    """The largest gap of each run and how many of its events come before it."""
    line = Window.partitionBy("run").orderBy("ts", "seq")
    g = _log(spark, f).select("run", "seq", "ts", (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(F.lag(C("ts").cast("timestamp")).over(line))).alias("gap"), F.row_number().over(line).alias("at"))
    best = g.where("gap is not null").groupBy("run").agg(F.max_by("at", F.struct("gap", -C("at"))).alias("at"), F.max("gap").alias("gap_us"))
    return best.where("gap_us >= 5000000").select("run", (C("at") - 1).alias("first_wave"), "gap_us")


def w21_role_runs(spark, f):
    log = _log(spark, f).withColumn("o", F.row_number().over(Window.partitionBy("run").orderBy("ts", "seq")))
    return K.islands(log, ["run"], "o", "kind").select("run", "kind", "first", "last", "n")


def w22_latest_status(spark, f):
    return D.draws(spark, f, "task", "system", "finish_reason", "t_req").groupBy("task", "system").agg(F.max_by("finish_reason", F.struct("t_req", "draw_id")).alias("status"), F.count(F.lit(1)).alias("attempts"))


_GIVEN = "given AS (SELECT DISTINCT task, pmid FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1) WHERE task IS NOT NULL AND pmid IS NOT NULL)"
_WEIGHT = "wt AS (SELECT task, pmid, count(*) AS weight FROM (SELECT task, unnest(list_distinct(pmids)) AS pmid FROM claim) GROUP BY ALL), cut AS (SELECT task, quantile_cont(weight, 0.75) AS q, quantile_cont(weight, 0.5) AS m FROM wt GROUP BY task), st AS (SELECT task, pmid, weight, CASE WHEN weight >= q AND weight > m THEN 'hub' ELSE 'tail' END AS stratum FROM wt JOIN cut USING (task))"
_LOG = """log AS (SELECT user_id AS run, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'llm' WHEN 'error' THEN 'failure' ELSE 'validate' END AS kind FROM events)"""
_BIN = lambda c: " + ".join(f"CAST({c} >= {e} AS INT)" for e in _EDGES)
_STATE = f"""{_LOG}, cnt AS (SELECT run, seq, ts, kind, coalesce(lag(kind) OVER w, 'start') AS stage, coalesce(sum(CAST(kind = 'search' AS INT)) OVER b, 0) AS ns, coalesce(sum(CAST(kind = 'llm' AS INT)) OVER b, 0) AS nl FROM log WINDOW w AS (PARTITION BY run ORDER BY ts, seq), b AS (PARTITION BY run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT run, seq, ts, kind, stage, {_BIN('ns')} AS searches, {_BIN('nl')} AS calls FROM cnt)"""
_CL = D.with_sql("claim")

ORACLE = {
    "a01_weighted_recall": f"{_CL}, {_GIVEN}, {_WEIGHT} SELECT st.task, stratum, round(sum(CASE WHEN g.pmid IS NOT NULL THEN weight ELSE 0 END) / sum(weight), 6) AS recall, count(*) AS n FROM st LEFT JOIN given g ON g.task = st.task AND g.pmid = st.pmid GROUP BY 1, 2",
    "a04_claim_coverage": f"{_CL}, {_GIVEN}, m AS (SELECT DISTINCT c.id FROM (SELECT id, task, unnest(pmids) AS pmid FROM claim) c JOIN given g USING (task, pmid)) SELECT task, tier, round(avg(CAST(m.id IS NOT NULL AS INT)), 6) AS coverage, count(*) AS n FROM claim LEFT JOIN m ON m.id = claim.id GROUP BY task, tier",
    "a05_integration": f"{_CL} SELECT task, round(avg(CAST(coalesce(len(list_distinct(pmids)), -1) >= 2 AS INT)), 6) AS multi_source, count(*) AS n FROM claim GROUP BY task",
    "a05_paper_reuse": f"{_CL}, u AS (SELECT task, pmid, count(DISTINCT id) AS claims FROM (SELECT task, id, unnest(pmids) AS pmid FROM claim) GROUP BY ALL) SELECT task, count(*) FILTER (claims >= 2) AS reused, count(*) AS papers FROM u GROUP BY task",
    "a07_order_concordance": f"{D.with_sql('section')}, s AS (SELECT task, id, title FROM section WHERE title IS NOT NULL AND (parent IS NULL OR parent = '')) SELECT a.task, round(avg(CAST(a.title < b.title AS INT)), 6) AS concordance, count(*) AS pairs FROM s a JOIN s b ON a.task = b.task AND a.id < b.id AND a.title <> b.title GROUP BY a.task",
    "a07_size_fit": f"{D.with_sql('claim', 'task')}, n AS (SELECT task, count(*) AS got FROM claim GROUP BY task) SELECT task, round(1 - least(1.0, abs(ln(got / n_claims))), 6) AS size_fit FROM task JOIN n USING (task) WHERE n_claims > 0",
    "a09_claims_per_paper": f"{_CL}, {_WEIGHT}, c AS (SELECT task, count(*) AS claims, count(DISTINCT section_id) AS sections FROM claim GROUP BY task), p AS (SELECT task, count(*) AS papers FROM wt GROUP BY task) SELECT task, round((claims / papers) / (1 + claims / papers), 6) AS density, sections FROM c LEFT JOIN p USING (task)",
    "a10_completion": f"{D.with_sql('draw')} SELECT task, system, max(CASE WHEN finish_reason = 'stop' AND error IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS completion FROM draw GROUP BY ALL",
    "a11_claim_tiers": f"{_CL}, q AS (SELECT task, quantile_cont(weight, 0.75) AS q FROM claim GROUP BY task) SELECT task, CASE WHEN groundedness IS NULL AND contradict IS NULL THEN 'unscorable' WHEN contradict >= 0.5 AND NOT coalesce(groundedness >= 0.5, false) THEN 'forbidden' WHEN groundedness >= 0.5 AND weight >= q THEN 'required' ELSE 'admissible' END AS tier, count(*) AS n FROM claim JOIN q USING (task) GROUP BY 1, 2",
    "a12_strata": f"{_CL}, {_WEIGHT} SELECT task, stratum, count(*) AS papers, sum(weight) AS weight FROM st GROUP BY 1, 2",
    "a12_central_claims": f"{_CL} SELECT task, paragraph_id, arg_min(id, (-weight, id)) AS central FROM claim WHERE paragraph_id IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2",
    "a13_section_distance": f"{D.with_sql('claim', 'section')}, t AS (SELECT task, id, row_number() OVER (PARTITION BY task ORDER BY id) AS o FROM section WHERE parent IS NULL OR parent = ''), c AS (SELECT claim.id, t.o FROM claim LEFT JOIN t ON t.task = claim.task AND t.id = claim.section_id), e AS (SELECT unnest(restatements) AS r FROM units) SELECT CASE WHEN abs(a.o - b.o) IS NULL THEN 'unknown' WHEN a.o = b.o THEN 'within' WHEN abs(a.o - b.o) = 1 THEN 'adjacent' ELSE 'distant' END AS kind, count(*) AS n FROM e JOIN c a ON a.id = r.source_id JOIN c b ON b.id = r.target_id GROUP BY 1",
    "a14_grounding": f"{_CL} SELECT task, CASE WHEN groundedness >= 0.5 THEN 'entailment' WHEN contradict >= 0.5 THEN 'contradiction' WHEN groundedness IS NULL THEN 'ungrounded' ELSE 'neutral' END AS label, count(*) AS claims, sum(len(ref_nos)) AS refs FROM claim GROUP BY 1, 2",
    "a15_evidence_jaccard": f"{_CL}, s AS (SELECT DISTINCT task, unnest(pmids) AS pmid FROM claim), z AS (SELECT task, count(*) AS n FROM s GROUP BY task), c AS (SELECT a.task AS a, b.task AS b, count(*) AS common FROM s a JOIN s b ON a.pmid = b.pmid AND a.task < b.task GROUP BY ALL) SELECT a, b, common, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN z x ON x.task = a JOIN z y ON y.task = b",
    "a18_citation_profile": f"{_CL}, n AS (SELECT task, section_type, count(*) AS n FROM claim WHERE section_type IS NOT NULL GROUP BY ALL) SELECT task, section_type, round(n / sum(n) OVER (PARTITION BY task), 6) AS share FROM n",
    "a20_allocation": f"{D.with_sql('claim', 'corpus')}, h AS (SELECT task, pmid, min(section_type) AS h FROM (SELECT task, section_type, unnest(pmids) AS pmid FROM claim WHERE section_type IS NOT NULL) GROUP BY ALL), x AS (SELECT task, h.pmid, h, coalesce(journal, 'none') AS s FROM h JOIN corpus ON CAST(corpus.pmid AS VARCHAR) = h.pmid), p AS (SELECT a.task, count(*) FILTER (a.h = b.h AND a.s = b.s) AS tp, count(*) FILTER (a.h <> b.h AND a.s = b.s) AS fp, count(*) FILTER (a.h = b.h AND a.s <> b.s) AS fn, count(*) FILTER (a.h <> b.h AND a.s <> b.s) AS tn FROM x a JOIN x b ON a.task = b.task AND a.pmid < b.pmid GROUP BY a.task), y AS (SELECT DISTINCT x.task, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn FROM x LEFT JOIN p USING (task)), e AS (SELECT *, tp + fp + fn + tn AS n, (tp + fp) * (tp + fn) / nullif(tp + fp + fn + tn, 0) AS ex, (2 * tp + fp + fn) / 2 AS mx FROM y) SELECT task, tp, fp, fn, tn, round((tp + tn) / nullif(n, 0), 6) AS rand, round(CASE WHEN mx <> ex THEN (tp - ex) / (mx - ex) END, 6) AS ari FROM e",
    "a21_allocation_extract": f"{_CL}, r AS (SELECT task, section_id, unnest(pmids) AS pmid FROM claim WHERE section_id IS NOT NULL) SELECT task, section_id, list_sort(list_distinct(list(pmid))) AS pmids FROM r GROUP BY 1, 2",
    "a24_budget_caps": "WITH e AS (SELECT user_id AS arm, CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT strftime(day, '%Y-%m-%d') AS day, event_type, max(n) AS cap, arg_max(arm, (n, arm)) AS arm FROM e GROUP BY day, event_type",
    "a25_bundle_cap": "WITH s AS (SELECT user_id AS arm, count(DISTINCT event_type) AS n FROM events GROUP BY 1) SELECT least(max(n), 1000) AS k_cap, min(arm) FILTER (n = (SELECT max(n) FROM s)) AS arm, quantile_cont(n, 0.5) AS median FROM s",
    "a26_run_resources": f"{D.with_sql('draw')} SELECT system, round(avg(n_prompt_tokens), 6) AS prompt_tokens, round(avg(wall_ms), 6) AS wall_ms, count(*) AS calls, count(error) AS errors FROM draw GROUP BY system",
    "a27_family_medians": f"{D.with_sql('draw')}, p AS (SELECT system, task, avg(n_completion_tokens) AS words FROM draw GROUP BY ALL) SELECT system, round(quantile_cont(words, 0.5), 6) AS median_words, count(*) AS tasks FROM p GROUP BY system",
    "a31_relative_reward": f"{D.with_sql('score')}, b AS (SELECT task, max(z) AS best FROM score GROUP BY task) SELECT system, round(sum(tanh((z - best) / 0.1)) / count(*), 6) AS reward FROM score JOIN b USING (task) GROUP BY system",
    "a32_word_budget": f"{_CL}, n AS (SELECT task, section_id, count(*) AS n FROM claim WHERE section_id IS NOT NULL GROUP BY ALL) SELECT task, section_id, CAST(greatest(250, least(900, round_even(6000.0 * (1 + n) / sum(1 + n) OVER (PARTITION BY task), 0))) AS INT) AS words FROM n",
    "a34_set_audit": f"{D.with_sql('claim', 'task')}, u AS (SELECT task, list_distinct(list(pmid)) AS used FROM (SELECT task, unnest(pmids) AS pmid FROM claim) GROUP BY task), a AS (SELECT task, list_distinct(list_concat(coalesce(hubs, []), coalesce(tail, []))) AS allowed FROM task) SELECT task, len(list_filter(used, lambda x: NOT list_contains(allowed, x))) AS not_allowed, len(list_filter(allowed, lambda x: NOT list_contains(used, x))) AS not_used FROM a JOIN u USING (task)",
    "a36_coverage": f"{_CL} SELECT task, section_type, count(*) AS n, count(groundedness) AS grounded, count(contradict) AS contradicted FROM claim GROUP BY 1, 2",
    "w01_split": "WITH t AS (SELECT task, cutoff % 5 AS topic, row_number() OVER (PARTITION BY cutoff % 5 ORDER BY sha256('20260824:' || task)) AS round FROM units WHERE cutoff IS NOT NULL) SELECT task, topic, round FROM t ORDER BY round, topic LIMIT 20",
    "w02_quota": "WITH g AS (SELECT c_nationkey, count(*) AS w FROM customer GROUP BY 1), p AS (SELECT c_nationkey, floor(w * 50 / sum(w) OVER ()) AS b, w * 50 / sum(w) OVER () AS s FROM g), r AS (SELECT *, row_number() OVER (ORDER BY round(s - b, 9) DESC, c_nationkey) AS rn, 50 - sum(b) OVER () AS left_ FROM p) SELECT c_nationkey, CAST(b + CAST(rn <= left_ AS INT) AS BIGINT) AS seats FROM r",
    "w03_selection": f"{D.with_sql('corpus')}, p AS (SELECT journal, pmid, coalesce(n_citation, 0) AS c, CAST(floor((2024 - year) / 2) AS BIGINT) AS win FROM corpus WHERE journal IS NOT NULL AND year <= 2024), n AS (SELECT journal, win, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT *, n * 30 / sum(n) OVER (PARTITION BY journal) AS share FROM n), b AS (SELECT journal, win, floor(share) AS base, round(share - floor(share), 9) AS frac FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY frac DESC, win) AS rn, 30 - sum(base) OVER (PARTITION BY journal) AS left_ FROM b), o AS (SELECT *, row_number() OVER (PARTITION BY journal, win ORDER BY c DESC, pmid) AS r FROM p) SELECT o.journal, o.win, pmid, o.r FROM o JOIN r USING (journal, win) WHERE o.r <= base + CAST(rn <= left_ AS INT)",
    "w04_first_occurrence": f"{_CL}, r AS (SELECT task, id, generate_subscripts(pmids, 1) - 1 AS pos, unnest(pmids) AS pmid FROM claim) SELECT task, pmid, id, pos FROM r QUALIFY row_number() OVER (PARTITION BY task, pmid ORDER BY id, pos) = 1",
    "w06_fusion": f"{D.with_sql('corpus')}, p AS (SELECT journal, pmid, row_number() OVER (PARTITION BY journal ORDER BY coalesce(n_citation, 0) DESC, pmid) * 2 AS ka, row_number() OVER (PARTITION BY journal ORDER BY year DESC NULLS LAST, pmid) * 3 AS kb FROM corpus WHERE journal IS NOT NULL), k AS (SELECT journal, pmid, least(ka, kb) AS key, CAST(kb < ka AS INT) AS list FROM p), r AS (SELECT journal, pmid, row_number() OVER (PARTITION BY journal ORDER BY key, list, pmid) AS rank FROM k) SELECT * FROM r WHERE rank <= 10",
    "w08_interleave": f"{_CL}, r AS (SELECT task, id, generate_subscripts(pmids, 1) AS depth, unnest(pmids) AS pmid FROM claim), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY task, pmid ORDER BY depth, id) = 1), k AS (SELECT task, pmid, row_number() OVER (PARTITION BY task ORDER BY depth, id, pmid) AS rank FROM o) SELECT * FROM k WHERE rank <= 12",
    "w09_truncate": f"{_CL}, s AS (SELECT task, section_id, sum(length(text)) AS words FROM claim WHERE section_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL), r AS (SELECT *, sum(words) OVER (PARTITION BY task ORDER BY section_id ROWS UNBOUNDED PRECEDING) - words AS before FROM s) SELECT task, section_id, words FROM r WHERE before < 1500",
    "w14_history": f"WITH {_LOG}, l AS (SELECT run, max(ts) AS last FROM log WHERE kind <> 'llm' GROUP BY run) SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY ts, seq) - 1 AS pos, CASE WHEN kind = 'llm' AND ts <= last THEN 'acquisition' WHEN kind = 'llm' THEN 'writing' ELSE kind END AS stage FROM log LEFT JOIN l USING (run)",
    "w16_states": f"WITH {_STATE} SELECT run, seq, stage, searches, calls FROM s",
    "w17_kernel": f"WITH {_STATE}, x AS (SELECT concat_ws('/', stage, searches, calls) AS state, kind, coalesce(lead(concat_ws('/', stage, searches, calls)) OVER (PARTITION BY run ORDER BY ts, seq), 'terminal') AS next FROM s), t AS (SELECT state, kind, next, count(*) AS n FROM x GROUP BY ALL) SELECT state, kind, next, n, round(n / sum(n) OVER (PARTITION BY state), 6) AS p FROM t",
    "w18_waves": f"WITH {_LOG}, g AS (SELECT run, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap, row_number() OVER w AS at_ FROM log WINDOW w AS (PARTITION BY run ORDER BY ts, seq)) SELECT run, arg_max(at_, (gap, -at_)) - 1 AS first_wave, max(gap) AS gap_us FROM g WHERE gap IS NOT NULL GROUP BY run HAVING max(gap) >= 5000000",
    "w21_role_runs": f"WITH {_LOG}, o AS (SELECT run, kind, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS o FROM log), g AS (SELECT *, o - row_number() OVER (PARTITION BY run, kind ORDER BY o) AS g FROM o) SELECT run, kind, min(o) AS first, max(o) AS last, count(*) AS n FROM g GROUP BY run, kind, g",
    "w22_latest_status": f"{D.with_sql('draw')} SELECT task, system, last(finish_reason ORDER BY t_req, draw_id) AS status, count(*) AS attempts FROM draw GROUP BY ALL",
}
QUERIES = {n: globals()[n] for n in ORACLE}
