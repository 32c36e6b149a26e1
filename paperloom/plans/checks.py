"""Queries of resolving joins, audits, exports and outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import matching as M
from paperloom.operators.components import connected_components
from paperloom.operators.hierarchy import resolve
from paperloom.session import Workspace
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col
EMPTY = "array<string>"


def _ext(spark, f):
    return latest(table(spark, f, "papers_ext"), ["ext_id"]).drop("loaded_at")


def s03_admission(spark, f):
    """How many papers the export keeps, and why it drops the others; each paper has one reason."""
    p = D.corpus(spark, f, "abstract", "year")
    why = F.when(C("abstract").isNull(), "no_abstract").when(F.length("abstract") <= 200, "short_abstract").when(C("year").isNull() | (C("year") > 2025), "year").otherwise("kept")
    return p.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def s05_metadata(spark, f):
    p = D.corpus(spark, f, "n_citation", "journal", "authors")
    return p.select("pmid", F.coalesce("n_citation", F.lit(0)).alias("n_citation"), F.size(F.slice(F.coalesce(F.from_json("authors", EMPTY), F.array().cast(EMPTY)), 1, 20)).alias("authors"), "journal")


def s08_call_log(spark, f):
    d = D.draws(spark, f, "prompt", "completion", "params", "role_sequence", "t_req", "t_done")
    ms = (F.unix_micros(C("t_done").cast("timestamp")) - F.unix_micros(C("t_req").cast("timestamp"))) / 1000
    return d.select("draw_id", F.length("prompt").alias("prompt_chars"), F.length("completion").alias("completion_chars"), F.round(ms, 3).alias("ms"), F.get_json_object("params", "$.max_tokens").cast("int").alias("max_tokens"), F.size("role_sequence").alias("roles"))


def s14_citation_store(spark, f):
    raw = table(spark, f, "papers").groupBy("pmid").agg(F.max_by(F.coalesce("citation_count", F.lit(-1)), F.struct("loaded_at", "faiss_id")).alias("n_citation"))
    return raw


def s16_metadata_subset(spark, f):
    wanted = D.claims(spark, f, "pmids").select(F.explode("pmids").alias("p")).select(C("p").cast("long").alias("pmid")).distinct()
    return D.corpus(spark, f, "title", "year").join(wanted, "pmid", "left_semi").select("pmid", "title", "year")


def s23_upsert(spark, f):
    s = D.scores(spark, f).withColumn("z", F.round("z", 6))
    new = s.where("system = '5-LOW'").withColumn("z", F.round(C("z") + 1, 6))
    return M.upsert(s, new, ["system", "task"]).select("system", "task", "cluster", "z")


def s24_running_totals(spark, f):
    line = Window.partitionBy("system", "task").orderBy("t_req", "draw_id").rowsBetween(Window.unboundedPreceding, 0)
    d = D.draws(spark, f, "task", "system", "n_prompt_tokens", "n_completion_tokens", "t_req")
    return d.select("draw_id", F.sum(F.coalesce("n_prompt_tokens", F.lit(0)) + F.coalesce("n_completion_tokens", F.lit(0))).over(line).alias("tokens"), F.count(F.lit(1)).over(line).alias("calls"))


def j01_reference_resolution(spark, f):
    known = M.unique_by(D.corpus(spark, f, "doi").select("pmid", M.fold_doi(C("doi")).alias("d")), "d", "pmid")
    e = _ext(spark, f).select("ext_id", "src", M.fold_doi(C("doi")).alias("d")).join(known, "d", "left")
    return e.groupBy("src").agg(F.round(F.avg(C("d").isNotNull().cast("int")), 6).alias("with_doi"), F.round(F.avg(C("pmid").isNotNull().cast("int")), 6).alias("resolved"), F.count(F.lit(1)).alias("n"))


def j03_allowlist(spark, f):
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("p")).select("task", C("p").cast("long").alias("pmid")).distinct()
    j = cited.join(D.corpus(spark, f, "year").select("pmid", "year"), "pmid", "left").join(D.tasks(spark, f).select("task", "cutoff", "review_pmid"), "task")
    ok = F.coalesce(C("year") <= C("cutoff"), C("year").isNull()) & ~C("pmid").eqNullSafe(C("review_pmid"))
    return j.where(ok).groupBy("task").agg(F.sort_array(F.collect_list("pmid")).alias("allow"))


def j05_bundle(spark, f):
    c = D.claims(spark, f, "ref_nos", "pmids", "weight").where("size(pmids) > 0").select("task", "weight", F.posexplode("pmids").alias("at", "pmid"), "ref_nos")
    rows = c.select("task", "pmid", F.coalesce("weight", F.lit(0)).alias("w"), F.get("ref_nos", C("at")).alias("ref"))
    g = rows.groupBy("task", "pmid").agg(F.sum("w").alias("weight"), F.min("ref").alias("ref_no"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(C("weight").desc(), C("ref_no").asc_nulls_last(), "pmid")))


def j06_heading_match(spark, f):
    ours = latest(table(spark, f, "outline_nodes"), ["system", "task", "id"]).select("system", "task", T.heading(C("title")).alias("title"))
    theirs = D.sections(spark, f, "title").select("task", T.heading(C("title")).alias("title"))
    return M.match_headings(ours, theirs, "task", per=("system",))


def j13_repeated_queries(spark, f):
    d = D.draws(spark, f, "task", "prompt").select("task", "draw_id", T.query_tokens(C("prompt")).alias("toks"), F.trim(F.regexp_replace(F.lower("prompt"), r"\s+", " ")).alias("norm")).where("task is not null and norm is not null")
    return M.near_repeats(d, "task", "draw_id", "toks", "norm").select("task", "draw_id", "earlier", F.round("similarity", 6).alias("similarity"), "kind")


def j15_redelivery(spark, f):
    """Rows that came more than once: whether their content agrees but for the time they came."""
    raw = table(spark, f, "claims")
    body = F.xxhash64(*[c for c in raw.columns if c != "loaded_at"])
    g = raw.select("id", body.alias("h")).groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("h").alias("forms"))
    return g.where("k > 1").agg(F.count(F.lit(1)).alias("repeated"), F.count_if(C("forms") > 1).alias("differing"))


def j19_references(spark, f):
    c = D.claims(spark, f, "section_id", "pmids")
    s = D.sections(spark, f, "title").select(F.concat_ws("/", "task", "id").alias("key"))
    links = table(spark, f, "units").select(F.explode("restatements").alias("r")).select(F.explode(F.array("r.source_id", "r.target_id")).alias("id"))
    papers = D.corpus(spark, f, "title").select(C("pmid").cast("string").alias("pmid"))
    found = [
        M.missing(c.where("section_id is not null").select(F.concat_ws("/", "task", "section_id").alias("key")), "key", s, "claim_without_section"),
        M.missing(c.select(F.explode("pmids").alias("pmid")), "pmid", papers, "cited_not_in_pool"),
        M.missing(links, "id", c, "link_to_no_claim"),
        M.repeated(table(spark, f, "claims"), ["id"], "claim_repeated"),
        M.repeated(table(spark, f, "sections"), ["task", "id"], "section_repeated"),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def j21_peers(spark, f):
    t = D.tasks(spark, f).where("cutoff is not null").select("task", "cutoff")
    sizes = t.groupBy("cutoff").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("first"))
    return t.join(sizes, "cutoff").select("task", (C("n") - 1).alias("peers"), "first")


def j22_leak_exclusion(spark, f):
    t = D.tasks(spark, f)
    held = t.where("cutoff < 2010").select(C("review_pmid").cast("string").alias("pmid")).where("pmid is not null")
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("pmid")).join(held, "pmid", "left_semi").select("task").distinct()
    return t.where("cutoff >= 2010").join(cited, "task", "left_anti").select("task", F.sha2("task", 256).alias("h")).orderBy("h").limit(15)


def j23_marker_join(spark, f):
    c = D.claims(spark, f, "ref_nos", "pmids").where("size(pmids) > 0")
    return c.select("task", F.explode(F.arrays_zip("ref_nos", "pmids")).alias("z")).where("z.ref_nos is not null and z.pmids is not null").groupBy("task", C("z.ref_nos").alias("ref_no")).agg(F.countDistinct("z.pmids").alias("papers"), F.count(F.lit(1)).alias("uses"))


def j26_route_audit(spark, f):
    allowed = spark.createDataFrame([("search",), ("plan",), ("ground",), ("write",)], "stage string")
    d = D.draws(spark, f, "stage").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(allowed.withColumn("ok", F.lit(True))), "stage", "left").select("stage", "n", F.coalesce("ok", F.lit(False)).alias("allowed"))


def j27_cascade(spark, f):
    p = D.corpus(spark, f, "title", "doi").select("pmid", M.fold_doi(C("doi")).alias("d"), M.fold_title(C("title")).alias("t"))
    e = _ext(spark, f).select("ext_id", "src", M.fold_doi(C("doi")).alias("d"), M.fold_title(C("title")).alias("t"))
    steps = [("doi", "d", M.unique_by(p, "d", "pmid")), ("title", "t", M.unique_by(p, "t", "pmid"))]
    return M.cascade(e, "pmid", steps).select("ext_id", "pmid", "matched_by")


def j29_entry_hash(spark, f):
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("pmid")).groupBy("task").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("pmid")), ","), 256).alias("cited"))
    listed = D.tasks(spark, f).select("task", F.sha2(F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("hubs", F.array().cast(EMPTY)), F.coalesce("tail", F.array().cast(EMPTY))))), ","), 256).alias("listed"))
    return listed.join(cited, "task").select("task", "cited", "listed", (C("cited") == C("listed")).alias("equal"))


def g07_communities(spark, f):
    """Papers cited together by a claim, linked along its list; groups of three and more."""
    pairs = D.claims(spark, f, "pmids").where("size(pmids) >= 2").select("task", F.explode(F.transform(F.sequence(F.lit(1), F.size("pmids") - 1), lambda i: F.struct(F.get("pmids", i - 1).cast("long").alias("x"), F.get("pmids", i).cast("long").alias("y")))).alias("e"))
    keyed = pairs.select(F.concat_ws("/", "task", "e.x").alias("x"), F.concat_ws("/", "task", "e.y").alias("y"))
    found = connected_components(keyed, "x", "y", Workspace(spark, "communities"))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")


def g10_top_section(spark, f):
    return resolve(table(spark, f, "sections").select("task", "id", "parent"), ["task"], paths=False).where("root is not null").select("task", "id", C("root").alias("top"))


def g09_shared_claims(spark, f):
    """Restatement pairs in two kinds of sections that share a claim."""
    e = table(spark, f, "units").select(F.explode("restatements").alias("r")).select(F.least("r.source_id", "r.target_id").alias("a"), F.greatest("r.source_id", "r.target_id").alias("b")).where("a < b").distinct()
    one, two = e.select(C("a").alias("x"), C("b").alias("mid")), e.select(C("a").alias("mid"), C("b").alias("z"))
    return one.join(two, "mid").select(F.array_sort(F.array("x", "mid", "z")).alias("nodes")).distinct()


def w12_report_sections(spark, f):
    d = latest(table(spark, f, "documents").select("doc_id", "text", "loaded_at"), ["doc_id"]).where("text is not null")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    sec = F.count_if(C("line").rlike("^#{1,6} ")).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    s = lines.withColumn("section", sec)
    return s.groupBy("doc_id", "section").agg(F.max(F.when(C("line").rlike("^#{1,6} "), F.trim(F.regexp_replace("line", "^#+ +", "")))).alias("title"), F.sum(F.when(~C("line").rlike("^#{1,6} "), T.word_count(C("line"))).otherwise(0)).alias("words"))


def w13_parent_section(spark, f):
    """The nearest earlier section of a lower heading level (1..6), in order of ids."""
    s = D.sections(spark, f, "level").where("level between 1 and 6").select("task", "id", "level")
    w = Window.partitionBy("task").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(C("level") == lv, C("id"))).over(w) for lv in range(1, 7)]
    best = F.greatest(*[F.when(C("level") > lv, x) for lv, x in zip(range(1, 7), last)])
    return s.withColumn("nearest", best).select("task", "id", "level", "nearest")


def r07_verification(spark, f):
    p = D.corpus(spark, f, "title").select(C("pmid").cast("string").alias("pmid"))
    docs = latest(table(spark, f, "documents").select("doc_id", "pmid", "task", "n_chars", "text", "loaded_at"), ["doc_id"])
    bad = docs.agg(F.count_if(F.length("text") != C("n_chars")).alias("n")).select(F.lit("length_differs").alias("rule"), "n")
    lost = M.missing(docs, "pmid", p, "paper_not_in_pool").unionByName(M.missing(docs, "task", D.tasks(spark, f), "unknown_task"))
    return lost.unionByName(bad)


def r09_schema(spark, f):
    d = D.draws(spark, f, "params")
    p = F.from_json("params", "temperature double, max_tokens int, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    why = F.when(C("params").isNull(), "absent").when(p["_bad"].isNotNull(), "broken").when(p["max_tokens"].isNull() | (p["max_tokens"] <= 0), "max_tokens").when(p["temperature"].isNull(), "temperature").otherwise("valid")
    return d.groupBy(why.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def r19_abstract_status(spark, f):
    """Each document against the abstract of its paper: by length, then by digest."""
    docs = latest(table(spark, f, "documents").select("doc_id", "pmid", "text", "loaded_at"), ["doc_id"]).where("pmid is not null")
    p = D.corpus(spark, f, "abstract").select(C("pmid").cast("string").alias("pmid"), "abstract")
    j = docs.join(p, "pmid", "left")
    why = F.when(C("abstract").isNull(), "missing").when(C("text").isNull(), "not_fetched").when((F.length("text") == F.length("abstract")) & (F.sha2("text", 256) == F.sha2("abstract", 256)), "verified").otherwise("drifted")
    return j.groupBy(why.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_EXT = "ext AS (SELECT * FROM papers_ext QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY loaded_at DESC) = 1)"
_DOCS = "doc AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"
_DOI = r"nullif(regexp_extract(replace(lower(trim(doi)), '%2f', '/'), '(10\.\d{4,9}/[^\s]+?)[.,;]*$', 1), '')"
_TITLE = "nullif(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), '')"
_CL, _WS = D.with_sql("claim"), r"[ \t\n\r\f\v]+"
_QTOK = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(prompt), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in T.QUERY_STOP)}) AND NOT regexp_full_match(t, '(19|20)[0-9][0-9]'))))"

ORACLE = {
    "s03_admission": f"{D.with_sql('corpus')} SELECT CASE WHEN abstract IS NULL THEN 'no_abstract' WHEN length(abstract) <= 200 THEN 'short_abstract' WHEN year IS NULL OR year > 2025 THEN 'year' ELSE 'kept' END AS reason, count(*) AS n FROM corpus GROUP BY 1",
    "s05_metadata": f"{D.with_sql('corpus')} SELECT pmid, coalesce(n_citation, 0) AS n_citation, least(20, coalesce(json_array_length(authors), 0)) AS authors, journal FROM corpus",
    "s08_call_log": f"{D.with_sql('draw')} SELECT draw_id, length(prompt) AS prompt_chars, length(completion) AS completion_chars, round((epoch_us(t_done) - epoch_us(t_req)) / 1000, 3) AS ms, CAST(json_extract(params, '$.max_tokens') AS INT) AS max_tokens, len(role_sequence) AS roles FROM draw",
    "s14_citation_store": "SELECT pmid, arg_max(coalesce(citation_count, -1), (loaded_at, faiss_id)) AS n_citation FROM papers GROUP BY pmid",
    "s16_metadata_subset": f"{D.with_sql('corpus', 'claim')} SELECT pmid, title, year FROM corpus WHERE CAST(pmid AS VARCHAR) IN (SELECT unnest(pmids) FROM claim)",
    "s23_upsert": f"{D.with_sql('score')} SELECT system, task, cluster, CASE WHEN system = '5-LOW' THEN round(round(z, 6) + 1, 6) ELSE round(z, 6) END AS z FROM score",
    "s24_running_totals": f"{D.with_sql('draw')} SELECT draw_id, sum(coalesce(n_prompt_tokens, 0) + coalesce(n_completion_tokens, 0)) OVER w AS tokens, count(*) OVER w AS calls FROM draw WINDOW w AS (PARTITION BY system, task ORDER BY t_req NULLS FIRST, draw_id ROWS UNBOUNDED PRECEDING)",
    "j01_reference_resolution": f"{D.with_sql('corpus')}, {_EXT}, k AS (SELECT {_DOI} AS d, min(pmid) AS pmid FROM corpus GROUP BY 1 HAVING min(pmid) = max(pmid)), e AS (SELECT ext_id, src, {_DOI} AS d FROM ext) SELECT src, round(avg(CAST(e.d IS NOT NULL AS INT)), 6) AS with_doi, round(avg(CAST(k.pmid IS NOT NULL AS INT)), 6) AS resolved, count(*) AS n FROM e LEFT JOIN k USING (d) GROUP BY src",
    "j03_allowlist": f"{D.with_sql('corpus', 'claim', 'task')}, w AS (SELECT DISTINCT task, CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) SELECT w.task, list_sort(list(w.pmid)) AS allow FROM w JOIN task t USING (task) LEFT JOIN corpus c USING (pmid) WHERE (c.year IS NULL OR c.year <= t.cutoff) AND w.pmid IS DISTINCT FROM t.review_pmid GROUP BY w.task",
    "j05_bundle": f"{_CL}, r AS (SELECT task, coalesce(weight, 0) AS w, unnest(pmids) AS pmid, ref_nos[generate_subscripts(pmids, 1)] AS ref FROM claim), g AS (SELECT task, pmid, sum(w) AS weight, min(ref) AS ref_no FROM r GROUP BY ALL) SELECT task, pmid, weight, ref_no, row_number() OVER (PARTITION BY task ORDER BY weight DESC, ref_no NULLS LAST, pmid) AS rank FROM g",
    "j13_repeated_queries": rf"{D.with_sql('draw')}, d AS (SELECT task, draw_id, {_QTOK} AS toks, trim(regexp_replace(lower(prompt), '{_WS}', ' ', 'g')) AS norm FROM draw WHERE task IS NOT NULL AND prompt IS NOT NULL), p AS (SELECT a.task, a.draw_id, b.draw_id AS earlier, a.norm = b.norm AS exact, len(list_filter(a.toks, lambda t: list_contains(b.toks, t))) AS c, len(a.toks) AS na, len(b.toks) AS nb FROM d a JOIN d b ON a.task = b.task AND b.draw_id < a.draw_id), q AS (SELECT task, draw_id, earlier, CASE WHEN exact THEN 1.0 ELSE c / (na + nb - c) END AS similarity, CASE WHEN exact THEN 'exact' ELSE 'near' END AS kind FROM p WHERE exact OR (na > 0 AND nb > 0 AND c / (na + nb - c) >= 0.8)) SELECT task, draw_id, earlier, round(similarity, 6) AS similarity, kind FROM q QUALIFY row_number() OVER (PARTITION BY task, draw_id ORDER BY kind, earlier) = 1",
    "j15_redelivery": "WITH g AS (SELECT id, count(*) AS k, count(DISTINCT (task, text, section_id, section_type, paragraph_id, ref_nos, pmids, groundedness, contradict, weight, tier)) AS forms FROM claims GROUP BY id) SELECT count(*) AS repeated, count(*) FILTER (forms > 1) AS differing FROM g WHERE k > 1",
    "j19_references": f"{D.with_sql('claim', 'section', 'corpus')}, l AS (SELECT unnest(restatements) AS r FROM units), ids AS (SELECT r.source_id AS id FROM l UNION SELECT r.target_id FROM l) SELECT 'claim_without_section' AS rule, (SELECT count(*) FROM (SELECT DISTINCT task, section_id AS id FROM claim WHERE section_id IS NOT NULL) ANTI JOIN section USING (task, id)) AS n UNION ALL SELECT 'cited_not_in_pool', (SELECT count(*) FROM (SELECT DISTINCT CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) ANTI JOIN corpus USING (pmid)) UNION ALL SELECT 'link_to_no_claim', (SELECT count(*) FROM (SELECT id FROM ids WHERE id IS NOT NULL) ANTI JOIN claim USING (id)) UNION ALL SELECT 'claim_repeated', (SELECT count(*) FROM (SELECT id FROM claims GROUP BY id HAVING count(*) > 1)) UNION ALL SELECT 'section_repeated', (SELECT count(*) FROM (SELECT task, id FROM sections GROUP BY task, id HAVING count(*) > 1))",
    "j21_peers": f"{D.with_sql('task')} SELECT task, count(*) OVER (PARTITION BY cutoff) - 1 AS peers, min(task) OVER (PARTITION BY cutoff) AS first FROM task WHERE cutoff IS NOT NULL",
    "j22_leak_exclusion": f"{D.with_sql('claim', 'task')}, held AS (SELECT CAST(review_pmid AS VARCHAR) AS pmid FROM task WHERE cutoff < 2010 AND review_pmid IS NOT NULL), leak AS (SELECT DISTINCT task FROM (SELECT task, unnest(pmids) AS pmid FROM claim) WHERE pmid IN (SELECT pmid FROM held)) SELECT task, sha256(task) AS h FROM task WHERE cutoff >= 2010 AND task NOT IN (SELECT task FROM leak) ORDER BY h LIMIT 15",
    "j23_marker_join": f"{_CL}, z AS (SELECT task, unnest(ref_nos) AS ref_no, unnest(pmids) AS pmid FROM claim WHERE len(pmids) > 0) SELECT task, ref_no, count(DISTINCT pmid) AS papers, count(*) AS uses FROM z WHERE ref_no IS NOT NULL AND pmid IS NOT NULL GROUP BY ALL",
    "j26_route_audit": f"{D.with_sql('draw')} SELECT stage, count(*) AS n, coalesce(stage IN ('search', 'plan', 'ground', 'write'), false) AS allowed FROM draw GROUP BY stage",
    "j27_cascade": f"{D.with_sql('corpus')}, {_EXT}, p AS (SELECT pmid, {_DOI} AS d, {_TITLE} AS t FROM corpus), kd AS (SELECT d, min(pmid) AS pmid FROM p WHERE d IS NOT NULL GROUP BY d HAVING min(pmid) = max(pmid)), kt AS (SELECT t, min(pmid) AS pmid FROM p WHERE t IS NOT NULL GROUP BY t HAVING min(pmid) = max(pmid)), e AS (SELECT ext_id, {_DOI} AS d, {_TITLE} AS t FROM ext) SELECT ext_id, coalesce(kd.pmid, kt.pmid) AS pmid, CASE WHEN kd.pmid IS NOT NULL THEN 'doi' WHEN kt.pmid IS NOT NULL THEN 'title' ELSE 'none' END AS matched_by FROM e LEFT JOIN kd USING (d) LEFT JOIN kt USING (t)",
    "j29_entry_hash": f"{D.with_sql('claim', 'task')}, c AS (SELECT task, sha256(string_agg(DISTINCT pmid, ',' ORDER BY pmid)) AS cited FROM (SELECT task, unnest(pmids) AS pmid FROM claim) GROUP BY task), l AS (SELECT task, sha256(array_to_string(list_sort(list_distinct(list_concat(coalesce(hubs, []), coalesce(tail, [])))), ',')) AS listed FROM task) SELECT task, cited, listed, cited = listed AS equal FROM l JOIN c USING (task)",
    "g07_communities": f"{D.with_sql('claim', recursive=True)}, e AS (SELECT DISTINCT task || '/' || pmids[i] AS x, task || '/' || pmids[i + 1] AS y FROM claim, range(1, 40) r(i) WHERE i < len(pmids) AND pmids[i] <> pmids[i + 1]), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), reach AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM reach r JOIN b ON r.y = b.x), m AS (SELECT x, least(x, min(y)) AS component FROM reach GROUP BY x) SELECT component, count(*) AS size FROM m GROUP BY component HAVING count(*) >= 3",
    "g09_shared_claims": "WITH l AS (SELECT unnest(restatements) AS r FROM units), e AS (SELECT DISTINCT least(r.source_id, r.target_id) AS a, greatest(r.source_id, r.target_id) AS b FROM l WHERE r.source_id <> r.target_id) SELECT DISTINCT list_sort([x.a, x.b, y.b]) AS nodes FROM e x JOIN e y ON x.b = y.a",
    "g10_top_section": "WITH RECURSIVE n AS (SELECT task, id, min(CASE WHEN parent <> '' THEN parent END) AS up FROM sections GROUP BY ALL), l AS (SELECT n.*, p.id AS link FROM n LEFT JOIN n p ON p.task = n.task AND p.id = n.up), d AS (SELECT task, id, id AS top FROM l WHERE link IS NULL UNION ALL SELECT l.task, l.id, d.top FROM d JOIN l ON l.task = d.task AND l.link = d.id) SELECT * FROM d",
    "w12_report_sections": rf"WITH {_DOCS}, l AS (SELECT doc_id, unnest(range(len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM doc WHERE text IS NOT NULL)), s AS (SELECT *, regexp_matches(line, '^#{{1,6}} ') AS head, count(*) FILTER (regexp_matches(line, '^#{{1,6}} ')) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS section FROM l) SELECT doc_id, section, max(CASE WHEN head THEN trim(regexp_replace(line, '^#+ +', '')) END) AS title, sum(CASE WHEN head THEN 0 ELSE len(regexp_extract_all(line, '[A-Za-z0-9_]+')) END) AS words FROM s GROUP BY 1, 2",
    "w13_parent_section": f"{D.with_sql('section')}, s AS (SELECT task, id, level FROM section WHERE level BETWEEN 1 AND 6) SELECT a.task, a.id, a.level, max(b.id) AS nearest FROM s a LEFT JOIN s b ON b.task = a.task AND b.id < a.id AND b.level < a.level GROUP BY ALL",
    "r07_verification": f"{D.with_sql('corpus', 'task')}, {_DOCS} SELECT 'paper_not_in_pool' AS rule, (SELECT count(*) FROM (SELECT DISTINCT pmid FROM doc WHERE pmid IS NOT NULL AND pmid NOT IN (SELECT CAST(pmid AS VARCHAR) FROM corpus))) AS n UNION ALL SELECT 'unknown_task', (SELECT count(*) FROM (SELECT DISTINCT task FROM doc WHERE task IS NOT NULL AND task NOT IN (SELECT task FROM task))) UNION ALL SELECT 'length_differs', (SELECT count(*) FROM doc WHERE length(text) <> n_chars)",
    "r09_schema": f"{D.with_sql('draw')} SELECT CASE WHEN params IS NULL THEN 'absent' WHEN NOT json_valid(params) THEN 'broken' WHEN coalesce(CAST(json_extract(params, '$.max_tokens') AS INT), 0) <= 0 THEN 'max_tokens' WHEN json_extract(params, '$.temperature') IS NULL THEN 'temperature' ELSE 'valid' END AS state, count(*) AS n FROM draw GROUP BY 1",
    "r19_abstract_status": f"{D.with_sql('corpus')}, {_DOCS} SELECT CASE WHEN abstract IS NULL THEN 'missing' WHEN text IS NULL THEN 'not_fetched' WHEN text = abstract THEN 'verified' ELSE 'drifted' END AS status, count(*) AS n FROM doc LEFT JOIN corpus c ON CAST(c.pmid AS VARCHAR) = doc.pmid WHERE doc.pmid IS NOT NULL GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "j06_heading_match"]}
