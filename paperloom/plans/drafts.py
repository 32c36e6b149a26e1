"""Queries that read drafts, references and calls back from logs, and distances of claim graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import artifacts as X
from paperloom.functions import text as T
from paperloom.operators import drafts as W
from paperloom.operators import transport as G
from paperloom.operators.matching import fold_title
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col
#: The openings by which the prompts of these runs show what they ask for.
SIGNATURES = [("outline", "^Draft an outline for a review titled"), ("section", '^Summarise the abstracts for the section "'), ("queries", "^Write search queries for"), ("check", "^Does the evidence support"), ("cite", "^List the PMIDs")]
#: A wider reading, in which a prompt may show several.
WORDS = [("outline", "(?i)outline"), ("section", "(?i)section"), ("queries", "(?i)search quer"), ("check", "(?i)evidence support"), ("cite", "(?i)pmids")]
ENDS = [("section", 'Summarise the abstracts for the section "', r"\."), ("outline", "Draft an outline for a review titled: ", "[A-Za-z0-9]"), ("check", "Does the evidence support the claim", r"[.)\]]")]
_SECTION, _TITLE = r'^Summarise the abstracts for the section "([^"]*)"', r"^Draft an outline for a review titled: (.*)$"


def _calls(spark, f):
    """The model calls with the role and the target of their prompt."""
    d = D.draws(spark, f, "task", "system", "prompt", "completion", "error", "t_req").where("task is not null and system is not null")
    role = W.role_of(C("prompt"), SIGNATURES)
    target = F.when(role == "section", F.regexp_extract("prompt", _SECTION, 1)).when(role == "outline", F.regexp_extract("prompt", _TITLE, 1))
    return d.withColumns({"role": role, "target": F.nullif(target, F.lit(""))})


def r05a_last_drafts(spark, f):
    """The last usable call of each target of a run, and in which of two waves it was asked.

    The waves part at the longest pause between usable calls of the run, if it is of 5 seconds or more.
    """
    good = _calls(spark, f).where(W.usable(C("completion"), C("error")) & C("t_req").isNotNull())
    line = Window.partitionBy("task", "system").orderBy("t_req", "draw_id")
    us = F.unix_micros(C("t_req").cast("timestamp"))
    gaps = good.select("task", "system", "t_req", "draw_id", (us - F.lag(us).over(line)).alias("gap"))
    cut = gaps.where("gap >= 5000000").groupBy("task", "system").agg(F.min_by("t_req", F.struct((-C("gap")).alias("g"), "t_req")).alias("second"))
    wanted = good.where("target is not null").select("task", "system", "role", "target", "t_req", "draw_id", F.length("completion").alias("chars"))
    last = W.drafts(wanted, ["task", "system", "role", "target"], ["t_req", "draw_id"])
    return last.join(cut, ["task", "system"], "left").select("task", "system", "role", "target", "draw_id", "chars", "calls", F.when(C("second").isNull() | (C("t_req") < C("second")), 1).otherwise(2).alias("wave"))


def r05b_first_drafts(spark, f):
    """The first draft of each section of a run, and how many papers its prompt's evidence names, by title or by its opening."""
    first = W.drafts(_calls(spark, f).where("role = 'section' and target is not null").select("task", "system", T.heading(C("target")).alias("section"), "t_req", "draw_id", "prompt"), ["task", "system", "section"], ["t_req", "draw_id"], "first")
    shown = first.select("draw_id", F.explode(F.regexp_extract_all("prompt", F.lit(r"(?m)^\[(\d+)\] (.*)$"), F.lit(2))).alias("line")).select("draw_id", "line", fold_title(C("line")).alias("fold")).where("fold is not null")
    p = D.corpus(spark, f, "title", "abstract").select("pmid", fold_title(C("title")).alias("t"), F.substring(fold_title(C("abstract")), 1, 200).alias("c"))
    titles = p.where("t is not null").groupBy("t").agg(F.min("pmid").alias("by_title"))
    openings = p.where("c is not null").groupBy("c").agg(F.min("pmid").alias("by_text"))
    found = shown.join(titles, C("fold") == C("t"), "left").join(openings, F.substring("fold", 1, 200) == C("c"), "left")
    n = found.groupBy("draw_id").agg(F.count(F.lit(1)).alias("shown"), F.count(F.coalesce("by_title", "by_text")).alias("resolved"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.join(n, "draw_id", "left").select("task", "system", "section", "draw_id", "calls", zero(C("shown")).alias("shown"), zero(C("resolved")).alias("resolved"))


def _outlines(spark, f):
    return _calls(spark, f).where(C("role") == "outline").where(W.usable(C("completion"), C("error"))).select("draw_id", F.split("completion", "\n").alias("lines"))


_ITEM = r"^( *)(\d+)[.)] +(.*\S)\s*$"


def _tree(spark, f):
    level = F.when(C("line").rlike(_ITEM), F.least(F.lit(6), F.floor(F.length(F.regexp_extract("line", _ITEM, 1)) / 2).cast("int") + 1))
    return W.outline_tree(_outlines(spark, f), "draw_id", "lines", level, F.regexp_extract("line", _ITEM, 3))


def r05c_skeletons(spark, f):
    """The nodes of drafted outlines with their parents, and whether they are leaves."""
    return _tree(spark, f)


def r05c_owners(spark, f):
    """Drafts of a run that a later prompt of the same run takes up, by their first 200 characters."""
    d = D.draws(spark, f, "task", "system", "prompt", "completion", "error")
    prompts = d.select("task", "system", C("draw_id").alias("prompt_id"), "prompt")
    texts = d.where(W.usable(C("completion"), C("error"))).select("task", "system", C("draw_id").alias("id"), C("completion").alias("text"))
    return W.owners(texts, prompts, ["task", "system"]).where("id <> prompt_id")


def r05d_filled_sections(spark, f):
    """Each section that a run was asked for, with the draft written first, or the note that there is none."""
    asked = _calls(spark, f).where("role = 'section' and target is not null")
    good = asked.where(W.usable(C("completion"), C("error"))).select("task", "system", "target", "t_req", "draw_id", F.sha2("completion", 256).alias("digest"))
    first = W.drafts(good, ["task", "system", "target"], ["t_req", "draw_id"], "first").select("task", "system", "target", "draw_id", "digest")
    return asked.select("task", "system", "target").distinct().join(first, ["task", "system", "target"], "left").select("task", "system", "target", "draw_id", F.coalesce("digest", F.lit("[no draft]")).alias("draft"))


def r05d_roles(spark, f):
    """How many calls of a system show exactly one signature, none, or several."""
    return D.draws(spark, f, "system", "prompt").groupBy("system", W.role_of(C("prompt"), WORDS, "only").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def r05e_roles(spark, f):
    return D.draws(spark, f, "system", "prompt").groupBy("system", W.role_by_ends(C("prompt"), ENDS).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def r05e_outlines(spark, f):
    """Outlines without the top section that repeats the one before it, at the head or at the tail."""
    top = _tree(spark, f).where("level = 1").withColumn("h", T.heading(C("title")))
    line = Window.partitionBy("draw_id").orderBy("k")
    back = Window.partitionBy("draw_id").orderBy(C("k").desc())
    placed = top.withColumns({"at": F.row_number().over(line), "from_end": F.row_number().over(back), "before": F.lag("h").over(line)})
    repeat = ((C("at") == 2) | (C("from_end") == 1)) & C("h").eqNullSafe(C("before"))
    return placed.where(~F.coalesce(repeat, F.lit(False))).groupBy("draw_id").agg(F.count(F.lit(1)).alias("sections"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "|"), 256).alias("digest"))


def r05f_json_outlines(spark, f):
    """Calls that answered in JSON, by stage: how the answer reads, and how many items it has."""
    d = D.draws(spark, f, "stage", "prompt", "completion").where(C("prompt").rlike("(?i)json"))
    s = d.select("stage", X.json_state(C("completion")).alias("s")).select("stage", "s.state", "s.n")
    return s.groupBy("stage", "state").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("items"))


def r05f_kept_share(spark, f):
    """How much of the first draft of a section is left in the last one of the same run, by words in common."""
    asked = _calls(spark, f).where("role = 'section' and target is not null").where(W.usable(C("completion"), C("error"))).select("task", "system", "target", "t_req", "draw_id", T.pool_tokens(C("completion")).alias("words"))
    keys = ["task", "system", "target"]
    first = W.drafts(asked, keys, ["t_req", "draw_id"], "first").select(*keys, C("draw_id").alias("first"), F.array_distinct("words").alias("a"))
    last = W.drafts(asked, keys, ["t_req", "draw_id"]).select(*keys, C("draw_id").alias("last"), F.array_distinct("words").alias("b"), "calls")
    both = first.join(last, keys).where("first <> last and size(a) > 0")
    return both.select(*keys, "first", "last", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("kept"))


def r15_call_match(spark, f):
    """Search calls of each system matched to events of the run's log: equal kind, in order of time."""
    d = D.draws(spark, f, "system", "stage", "error", "t_req", "t_done").where("stage = 'search' and t_req is not null")
    calls = d.select("system", F.date_trunc("day", "t_req").alias("day"), C("draw_id").alias("call"), C("t_req").alias("t"))
    log = d.where("t_done is not null and error is null").select("system", F.date_trunc("day", "t_req").alias("day"), C("draw_id").alias("line"), C("t_done").alias("t"))
    m = W.nearest_unused(calls, log, ["system", "day"], 3600.0)
    return m.groupBy("system").agg(F.count(F.lit(1)).alias("calls"), F.count("line").alias("matched"))


def _reports(spark, f):
    return latest(table(spark, f, "documents").select("doc_id", "text", "loaded_at"), ["doc_id"]).where("text is not null")


def _references(spark, f):
    return W.references(_reports(spark, f), "doc_id", "text")


def r15_references(spark, f):
    return _references(spark, f).groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"), F.sum(C("calls") - 1).alias("repeated"), F.count_if(C("body").rlike(r"\b\d{8,9}\b")).alias("with_pmid"))


def r15_citations(spark, f):
    """How the numbers cited in abstracts resolve: to a reference of a claim of the task that cites the paper, or not."""
    cited = D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", F.explode(T.reference_ids(C("abstract"), 200)).alias("n"))
    refs = D.claims(spark, f, "ref_nos", "pmids").where("size(pmids) > 0").select(F.explode(F.arrays_zip("ref_nos", "pmids")).alias("z")).where("z.ref_nos is not null").select(C("z.ref_nos").alias("n"), C("z.pmids").alias("of")).groupBy("n").agg(F.countDistinct("of").alias("papers"))
    j = cited.join(refs, "n", "left")
    return j.groupBy("pmid").agg(F.count(F.lit(1)).alias("numbers"), F.count("papers").alias("known"), F.coalesce(F.sum("papers"), F.lit(0)).alias("papers"))


def r15_refusals(spark, f):
    """Answers of a system that decline: short, in the first person, without figures."""
    c = F.trim(F.coalesce("completion", F.lit("")))
    declined = c.rlike(r"(?i)\b(i|we) (can't|cannot|can not|won't|am unable|are unable|must decline)") & (F.length(c) < 400) & ~c.rlike(r"\d")
    return D.draws(spark, f, "system", "completion").groupBy("system").agg(F.count_if(declined).alias("refusals"), F.count(F.lit(1)).alias("calls"))


def g16_graph_distance(spark, f):
    """Fused distance of each task's claim graph to that of the next task of its cutoff.

    Nodes are the first 400 claims by id, which is part of the distance's definition; edges are the
    task's restatements; claims differ by one less the overlap of the papers they cite.
    """
    claims = D.claims(spark, f, "pmids").where("task is not null").select("task", "id", "pmids")
    first = claims.withColumn("at", F.row_number().over(Window.partitionBy("task").orderBy("id"))).where(C("at") <= G.MAX_NODES)
    nodes = first.groupBy("task").agg(F.sort_array(F.collect_list(F.struct("at", "id", F.coalesce("pmids", F.array().cast("array<string>")).alias("pmids")))).alias("nodes"))
    links = table(spark, f, "units").select("task", F.explode("restatements").alias("r")).select("task", C("r.source_id").alias("a"), C("r.target_id").alias("b")).distinct()
    ends = first.select("task", "id", "at")
    inside = links.join(ends.select("task", C("id").alias("a"), C("at").alias("x")), ["task", "a"]).join(ends.select("task", C("id").alias("b"), C("at").alias("y")), ["task", "b"]).where("x <> y")
    graph = nodes.join(inside.groupBy("task").agg(F.collect_list(F.struct("x", "y")).alias("edges")), "task", "left")
    t = D.tasks(spark, f).where("cutoff is not null").select("task", F.lead("task").over(Window.partitionBy("cutoff").orderBy("task")).alias("peer")).where("peer is not null")
    pairs = t.join(graph, "task").join(graph.select(C("task").alias("peer"), C("nodes").alias("nodes_b"), C("edges").alias("edges_b")), "peer")

    def run(batches):
        for pdf in batches:
            values = [G.graph_distance(a, e, b, g) for a, e, b, g in zip(pdf["nodes"], pdf["edges"], pdf["nodes_b"], pdf["edges_b"])]
            yield pd.DataFrame({"task": pdf["task"], "peer": pdf["peer"], "distance": values})

    return pairs.select("task", "peer", "nodes", "edges", "nodes_b", "edges_b").repartition(spark.sparkContext.defaultParallelism, "task").mapInPandas(run, "task string, peer string, distance double")


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(prompt, '{p}') THEN '{n}'" for n, p in SIGNATURES) + " ELSE 'other' END"
_CALL = rf"""{D.with_sql('draw')}, call AS (SELECT *, CASE role WHEN 'section' THEN nullif(regexp_extract(prompt, '{_SECTION}', 1), '') WHEN 'outline' THEN nullif(regexp_extract(prompt, '{_TITLE.replace('(.*)$', '([^\n]*)$')}', 1), '') END AS target, coalesce(regexp_matches(completion, '\S'), false) AND error IS NULL AS usable FROM (SELECT *, {_CASE} AS role FROM draw WHERE task IS NOT NULL AND system IS NOT NULL))"""
_HEADING = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+', ''), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g')"
_FOLD = lambda c: f"nullif(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '')"
_NODE = rf"""{_CALL}, ln AS (SELECT draw_id, unnest(range(len(x)))::INT AS k, unnest(x) AS line FROM (SELECT draw_id, string_split(completion, chr(10)) AS x FROM call WHERE role = 'outline' AND usable)),
nd AS (SELECT draw_id, k, least(6, length(regexp_extract(line, '{_ITEM}', 1)) // 2 + 1)::INT AS level, regexp_extract(line, '{_ITEM}', 3) AS title FROM ln WHERE regexp_matches(line, '{_ITEM}'))"""
_STOP = ", ".join(f"'{w}'" for w in T.POOL_STOP)
_SET = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})))"
_DOC = "doc AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"

ORACLE = {
    "r05a_last_drafts": f"""{_CALL}, g AS (SELECT * FROM call WHERE usable AND t_req IS NOT NULL), gap AS (SELECT task, system, t_req, epoch_us(t_req) - lag(epoch_us(t_req)) OVER (PARTITION BY task, system ORDER BY t_req, draw_id) AS gap FROM g),
cut AS (SELECT task, system, t_req AS second FROM gap WHERE gap >= 5000000 QUALIFY row_number() OVER (PARTITION BY task, system ORDER BY gap DESC, t_req) = 1),
l AS (SELECT task, system, role, target, draw_id, length(completion) AS chars, t_req, count(*) OVER (PARTITION BY task, system, role, target) AS calls FROM g WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, system, role, target ORDER BY t_req DESC, draw_id DESC) = 1)
SELECT task, system, role, target, draw_id, chars, calls, CASE WHEN second IS NULL OR t_req < second THEN 1 ELSE 2 END AS wave FROM l LEFT JOIN cut USING (task, system)""",
    "r05b_first_drafts": rf"""{_CALL}, {D.SQL['corpus']}, s AS (SELECT task, system, {_HEADING('target')} AS section, draw_id, prompt, t_req FROM call WHERE role = 'section' AND target IS NOT NULL),
f AS (SELECT *, count(*) OVER (PARTITION BY task, system, section) AS calls FROM s QUALIFY row_number() OVER (PARTITION BY task, system, section ORDER BY t_req NULLS FIRST, draw_id) = 1),
e AS (SELECT draw_id, {_FOLD('line')} AS fold FROM (SELECT draw_id, unnest(regexp_extract_all(prompt, '(?m)^\[(\d+)\] (.*)$', 2)) AS line FROM f)),
ti AS (SELECT DISTINCT {_FOLD('title')} AS t FROM corpus), op AS (SELECT DISTINCT substr({_FOLD('abstract')}, 1, 200) AS c FROM corpus),
n AS (SELECT draw_id, count(*) AS shown, count(*) FILTER (fold IN (SELECT t FROM ti WHERE t IS NOT NULL) OR substr(fold, 1, 200) IN (SELECT c FROM op WHERE c IS NOT NULL)) AS resolved FROM e WHERE fold IS NOT NULL GROUP BY draw_id)
SELECT task, system, section, draw_id, calls, coalesce(shown, 0) AS shown, coalesce(resolved, 0) AS resolved FROM f LEFT JOIN n USING (draw_id)""",
    "r05c_skeletons": f"{_NODE} SELECT a.draw_id, a.k, a.level, a.title, max(b.k) AS parent, NOT EXISTS (SELECT 1 FROM nd c WHERE c.draw_id = a.draw_id AND c.k = (SELECT min(k) FROM nd d WHERE d.draw_id = a.draw_id AND d.k > a.k) AND c.level > a.level) AS leaf FROM nd a LEFT JOIN nd b ON b.draw_id = a.draw_id AND b.k < a.k AND b.level < a.level GROUP BY ALL",
    "r05c_owners": rf"{D.with_sql('draw')}, s AS (SELECT task, system, draw_id, trim(regexp_replace(prompt, '[ \t\n\r\f\v]+', ' ', 'g')) AS p, trim(regexp_replace(completion, '[ \t\n\r\f\v]+', ' ', 'g')) AS c, error FROM draw) SELECT a.task, a.system, a.draw_id AS id, b.draw_id AS prompt_id FROM s a JOIN s b ON a.task = b.task AND a.system = b.system AND a.draw_id <> b.draw_id WHERE a.error IS NULL AND length(a.c) >= 200 AND contains(b.p, substr(a.c, 1, 200))",
    "r05d_filled_sections": f"{_CALL}, a AS (SELECT DISTINCT task, system, target FROM call WHERE role = 'section' AND target IS NOT NULL), f AS (SELECT task, system, target, draw_id, sha256(completion) AS digest FROM call WHERE role = 'section' AND target IS NOT NULL AND usable QUALIFY row_number() OVER (PARTITION BY task, system, target ORDER BY t_req NULLS FIRST, draw_id) = 1) SELECT task, system, target, draw_id, coalesce(digest, '[no draft]') AS draft FROM a LEFT JOIN f USING (task, system, target)",
    "r05d_roles": f"""{D.with_sql('draw')}, h AS (SELECT system, list_filter([{', '.join(f"CASE WHEN regexp_matches(prompt, '{p}') THEN '{n}' END" for n, p in WORDS)}], lambda x: x IS NOT NULL) AS h FROM draw) SELECT system, CASE len(h) WHEN 1 THEN h[1] WHEN 0 THEN 'unmatched' ELSE 'ambiguous' END AS role, count(*) AS n FROM h GROUP BY 1, 2""",
    "r05e_roles": f"""{D.with_sql('draw')} SELECT system, CASE {' '.join(f"WHEN regexp_matches(prompt, '^(?:{h})') AND regexp_matches(prompt, '(?:{t})" + chr(92) + f"s*$') THEN '{n}'" for n, h, t in ENDS)} ELSE 'other' END AS role, count(*) AS n FROM draw GROUP BY 1, 2""",
    "r05e_outlines": f"{_NODE}, t AS (SELECT draw_id, k, {_HEADING('title')} AS h FROM nd WHERE level = 1), p AS (SELECT *, row_number() OVER (PARTITION BY draw_id ORDER BY k) AS at_, row_number() OVER (PARTITION BY draw_id ORDER BY k DESC) AS fe, lag(h) OVER (PARTITION BY draw_id ORDER BY k) AS before FROM t) SELECT draw_id, count(*) AS sections, sha256(string_agg(h, '|' ORDER BY k)) AS digest FROM p WHERE NOT ((at_ = 2 OR fe = 1) AND coalesce(h = before, false)) GROUP BY draw_id",
    "r05f_kept_share": f"{_CALL}, s AS (SELECT task, system, target, draw_id, t_req, {_SET('completion')} AS w FROM call WHERE role = 'section' AND target IS NOT NULL AND usable), a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task, system, target ORDER BY t_req NULLS FIRST, draw_id) = 1), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY task, system, target ORDER BY t_req DESC NULLS LAST, draw_id DESC) = 1) SELECT task, system, target, a.draw_id AS first, b.draw_id AS last, round(len(list_intersect(a.w, b.w)) / len(a.w), 6) AS kept FROM a JOIN b USING (task, system, target) WHERE a.draw_id <> b.draw_id AND len(a.w) > 0",
    "r15_call_match": f"{D.with_sql('draw')}, d AS (SELECT *, date_trunc('day', t_req) AS day FROM draw WHERE stage = 'search' AND t_req IS NOT NULL), c AS (SELECT system, day, t_req AS t, row_number() OVER (PARTITION BY system, day ORDER BY t_req, draw_id) AS k FROM d), l AS (SELECT system, day, t_done AS t, row_number() OVER (PARTITION BY system, day ORDER BY t_done, draw_id) AS k FROM d WHERE t_done IS NOT NULL AND error IS NULL) SELECT c.system, count(*) AS calls, count(*) FILTER (abs(epoch_us(c.t) - epoch_us(l.t)) <= 3600000000) AS matched FROM c LEFT JOIN l ON l.system IS NOT DISTINCT FROM c.system AND l.day = c.day AND l.k = c.k GROUP BY 1",
    "r15_references": rf"WITH {_DOC}, l AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM doc WHERE text IS NOT NULL)), h AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AS head FROM l), u AS (SELECT *, max(CASE WHEN head THEN k END) OVER (PARTITION BY doc_id ORDER BY k) AS at_ FROM h), r AS (SELECT u.* FROM u JOIN h ON h.doc_id = u.doc_id AND h.k = u.at_ WHERE NOT u.head AND regexp_matches(h.line, '(?i)^#{{1,6}} +(\d+[.)]? +)?(references|bibliography):?\s*$')), e AS (SELECT doc_id, k, TRY_CAST(regexp_extract(line, '^\s*\[?(\d+)[\].)]\s+(.*)$', 1) AS INT) AS n, regexp_extract(line, '^\s*\[?(\d+)[\].)]\s+(.*)$', 2) AS body FROM r), f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n) AS calls FROM e WHERE n IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY k) = 1) SELECT doc_id, count(*) AS entries, sum(calls - 1) AS repeated, count(*) FILTER (regexp_matches(body, '\b\d{{8,9}}\b')) AS with_pmid FROM f GROUP BY doc_id",
    "r15_refusals": r"WITH d AS (SELECT system, trim(coalesce(completion, '')) AS c FROM draws QUALIFY row_number() OVER (PARTITION BY draw_id ORDER BY loaded_at DESC) = 1) SELECT system, count(*) FILTER (regexp_matches(c, '(?i)\b(i|we) (can''t|cannot|can not|won''t|am unable|are unable|must decline)') AND length(c) < 400 AND NOT regexp_matches(c, '\d')) AS refusals, count(*) AS calls FROM d GROUP BY system",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "r05f_json_outlines", "r15_citations", "g16_graph_distance"]}
