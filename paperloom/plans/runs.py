"""Queries over runs, windows and boards that build on several operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import artifacts as X
from paperloom.functions import text as T
from paperloom.operators import matching as M
from paperloom.operators import ranking as K
from paperloom.operators import readouts as R
from paperloom.plans import stats as ST
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col


def t07_careful_sentences(spark, f):
    return D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", F.size(X.careful_sentences(C("abstract"))).alias("n"), F.sha2(F.array_join(X.careful_sentences(C("abstract")), "|"), 256).alias("digest"))


def t19_labels(spark, f):
    d = D.draws(spark, f, "stage", "finish_reason", "n_completion_tokens", "error")
    action = F.when(C("stage") == "search", "retrieve").when(C("stage").isin("plan", "refine"), "plan").otherwise("write")
    effect = F.when(C("error").isNotNull(), "failed").when(C("finish_reason") == "length", "cut").when(F.coalesce("n_completion_tokens", F.lit(0)) == 0, "none").otherwise("text")
    return d.groupBy(action.alias("action"), T.resource_bin(C("n_completion_tokens")).alias("bin"), effect.alias("effect")).agg(F.count(F.lit(1)).alias("n"))


def t22_render_variants(spark, f):
    """Which way of writing an abstract its digest was taken of."""
    p = D.corpus(spark, f, "abstract").where("abstract <> ''").select("pmid", "abstract")
    made = F.when(C("pmid") % 3 == 0, F.upper("abstract")).when(C("pmid") % 3 == 1, F.lower("abstract")).otherwise(F.concat(F.lit("ABSTRACT: "), "abstract"))
    wanted = p.select("pmid", "abstract", F.sha2(made, 256).alias("digest"), F.length(made).alias("len"))
    ways = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("way"), t.alias("text")) for i, (n, t) in enumerate([("plain", C("abstract")), ("upper", F.upper("abstract")), ("lower", F.lower("abstract")), ("labelled", F.concat(F.lit("ABSTRACT: "), "abstract"))])])
    hit = wanted.select("pmid", "digest", "len", F.explode(ways).alias("w")).where((F.length("w.text") == C("len")) & (F.sha2("w.text", 256) == C("digest")))
    return hit.groupBy("pmid").agg(F.min_by("w.way", "w.ord").alias("way"))


def t23_json_states(spark, f):
    return D.draws(spark, f, "completion").select("draw_id", X.json_state("completion").alias("j")).select("draw_id", "j.state", "j.n")


def t30_similarity(spark, f):
    e = table(spark, f, "units").select(F.explode("restatements").alias("r")).select(C("r.source_id").alias("s"), C("r.target_id").alias("t")).distinct()
    c = D.claims(spark, f, "text").select("id", "text")
    j = e.join(c.select(C("id").alias("s"), C("text").alias("a")), "s").join(c.select(C("id").alias("t"), C("text").alias("b")), "t")
    return j.select("s", "t", F.round(X.text_similarity("a", "b"), 6).alias("similarity"))


def l15_metered_pool(spark, f):
    """Per run and paper: the best score, the first step it came up and the event that brought it."""
    e = table(spark, f, "events").select(C("user_id").alias("run"), F.get_json_object("props", "$.k").cast("int").alias("paper"), "value", "ts", "event_id").where("paper is not null")
    return e.groupBy("run", "paper").agg(F.max("value").alias("best"), F.min("event_id").alias("first_step"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count(F.lit(1)).alias("times"))


def l19_stubs(spark, f):
    c = D.claims(spark, f, "pmids").where("size(pmids) > 0").groupBy("task").agg(F.slice(F.array_sort(F.collect_set(F.element_at("pmids", 1))), 1, 100).alias("stubs"))
    return D.tasks(spark, f).join(c, "task", "left").select("task", F.coalesce(F.size("stubs"), F.lit(0)).alias("n_stubs"), F.element_at("stubs", 1).alias("first"))


def v06_sub_index(spark, f):
    keep = table(spark, f, "events").select(C("user_id").alias("id")).distinct()
    sub = D.vectors(spark, f).join(keep, "id", "left_semi")
    return sub.select("label", "id").withColumn("row", F.row_number().over(Window.partitionBy("label").orderBy("id")))


def v11_tap_split(spark, f):
    k = F.get_json_object("props", "$.k").cast("int")
    size = F.when(k == 100, "subsection").when(k > 90, "pool").otherwise("outline")
    return table(spark, f, "events").groupBy("user_id", size.alias("kind")).agg(F.count(F.lit(1)).alias("calls"), F.min("event_id").alias("first"))


def g05_edge_page(spark, f):
    e = D.edges(spark, f).where("src <> dst").distinct()
    w = Window.partitionBy("dst").orderBy("src")
    n = e.groupBy("dst").agg(F.count(F.lit(1)).alias("total"))
    return e.withColumn("rank", F.row_number().over(w)).where("rank > 10 and rank <= 20").join(n, "dst").select("dst", "src", "rank", F.when(C("total") > 20, 20).alias("next"))


def g14_claim_graph(spark, f):
    """Restatement links typed by where they lead; links across tasks are hard negatives."""
    e = table(spark, f, "units").select(F.explode("restatements").alias("r")).select(C("r.source_id").alias("s"), C("r.target_id").alias("t")).where("s <> t").distinct()
    c = D.claims(spark, f, "section_id", "groundedness").select("id", "task", "section_id", "groundedness")
    j = e.join(c.select(C("id").alias("s"), C("task").alias("ts"), C("section_id").alias("ss"), C("groundedness").alias("gs")), "s").join(c.select(C("id").alias("t"), C("task").alias("tt"), C("section_id").alias("st")), "t")
    kind = F.when(C("ts") != C("tt"), "hard_negative").when(C("ss") == C("st"), "within").otherwise("across")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gs"), 6).alias("groundedness"))


def j04_canonical_bundle(spark, f):
    """For each task the visible cited papers with year from the pool, else from the listings by title."""
    ext = latest(table(spark, f, "papers_ext"), ["ext_id"]).select(F.lower("title").alias("t"), F.regexp_extract("date", r"(19|20)\d\d", 0).try_cast("int").alias("y")).where("t <> '' and y is not null").groupBy("t").agg(F.min("y").alias("ext_year"))
    p = D.corpus(spark, f, "title", "year").withColumn("t", F.lower("title")).join(ext, "t", "left").select("pmid", F.coalesce("year", "ext_year").alias("year"), F.when(C("year").isNotNull(), "pool").when(C("ext_year").isNotNull(), "listing").otherwise("none").alias("source"))
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("p")).select("task", C("p").cast("long").alias("pmid")).distinct()
    j = cited.join(D.tasks(spark, f).select("task", "cutoff"), "task").join(p, "pmid").where(F.coalesce(C("year") <= C("cutoff"), F.lit(False)))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("pmid"))).select("task", "pmid", "year", "source", "rank")


def j09_exact_channel(spark, f):
    """Claims that stand word for word as a line of a document of their task."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    docs = latest(table(spark, f, "documents").select("doc_id", "task", "text", "loaded_at"), ["doc_id"]).where("task is not null and text is not null")
    lines = docs.select("task", F.explode(F.split("text", "\n")).alias("line")).select("task", norm(F.regexp_replace("line", "^- ", "")).alias("n")).where("length(n) >= 20").distinct()
    c = D.claims(spark, f, "text").select("id", "task", norm(C("text")).alias("n")).where("length(n) >= 20")
    hit = c.join(lines.withColumn("hit", F.lit(1)), ["task", "n"], "left")
    return hit.groupBy("task").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("claims"))


def j12_colocation(spark, f):
    e = table(spark, f, "units").select(F.explode("restatements").alias("r")).select(F.least("r.source_id", "r.target_id").alias("a"), F.greatest("r.source_id", "r.target_id").alias("b")).where("a < b").distinct()
    c = D.claims(spark, f, "section_id", "paragraph_id").select("id", "task", "paragraph_id", "section_id")
    j = e.join(c.select(*[C(x).alias(x + "_a") for x in c.columns]), C("a") == C("id_a")).join(c.select(*[C(x).alias(x + "_b") for x in c.columns]), C("b") == C("id_b"))
    same = C("task_a") == C("task_b")
    kind = F.when(same & (C("paragraph_id_a") == C("paragraph_id_b")), "strong").when(same & (C("section_id_a") == C("section_id_b")), "weak").otherwise("none")
    return j.select("a", "b", kind.alias("kind"))


def j14_containment(spark, f):
    """For each listing the one of its venue whose title shares most of the shorter one's telling words, half at least."""
    e = latest(table(spark, f, "papers_ext").select("ext_id", "venue", "title", "loaded_at"), ["ext_id"]).select("ext_id", "venue", T.query_tokens(C("title")).alias("w"))
    return M.containment(e, "ext_id", "venue", "w").select("ext_id", "partner", F.round("containment", 6).alias("containment"), "links")


def j18_restore(spark, f):
    """Texts put back by digest: a claim's text is found again only if the digest agrees."""
    c = D.claims(spark, f, "text").where("text is not null").select("id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    texts = table(spark, f, "claims").where("text is not null").select(F.sha2("text", 256).alias("h"), "text").groupBy("h").agg(F.first("text").alias("text"))
    return c.join(texts, "h").where(F.length("text") == C("n")).groupBy(F.substring("id", 1, 8).alias("task")).agg(F.count(F.lit(1)).alias("restored"))


def j20_delivery(spark, f):
    t = D.tasks(spark, f)
    n = D.claims(spark, f, "text").groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    why = F.when(C("cutoff").isNull(), "no_cutoff").when(C("hubs").isNull(), "no_hubs").when(C("n_claims") != C("n"), "claims_differ").otherwise("ok")
    return t.join(n, "task", "left").groupBy(why.alias("state")).agg(F.count(F.lit(1)).alias("tasks"))


def j24_baseline_list(spark, f):
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("p")).select("task", C("p").cast("long").alias("pmid")).distinct()
    j = cited.join(D.corpus(spark, f, "abstract", "year").select("pmid", "year", "abstract"), "pmid", "left").join(D.tasks(spark, f).select("task", "cutoff", "review_pmid"), "task")
    ok = (F.coalesce("year", "cutoff") <= C("cutoff")) & ~C("pmid").eqNullSafe(C("review_pmid"))
    return j.where(ok).groupBy("task").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.trim(F.coalesce("abstract", F.lit(""))) != "").alias("with_abstract"))


def j25_recomputed(spark, f):
    """The citation weights found by two different plans, and how many rows differ."""
    c = D.claims(spark, f, "pmids", "weight")
    one = R.citation_weights(c)
    two = c.select("task", "id", F.explode("pmids").alias("pmid")).distinct().groupBy("task", "pmid").agg(F.countDistinct("id").alias("weight"))
    return one.exceptAll(two).unionByName(two.exceptAll(one)).agg(F.count(F.lit(1)).alias("differing"))


def a03_hub_recall_at(spark, f):
    """Share of a task's hubs cited within its first 5, 10 and 20 claims."""
    c = D.claims(spark, f, "pmids").withColumn("o", F.row_number().over(Window.partitionBy("task").orderBy("id"))).select("task", "o", F.explode("pmids").alias("pmid")).groupBy("task", "pmid").agg(F.min("o").alias("o"))
    hubs = D.tasks(spark, f).select("task", F.explode(F.array_distinct("hubs")).alias("pmid"))
    at = [F.round(F.avg((C("o") <= k).cast("int")), 6).alias(f"at_{k}") for k in (5, 10, 20)]
    return hubs.join(c, ["task", "pmid"], "left").withColumn("o", F.coalesce("o", F.lit(1 << 30))).groupBy("task").agg(*at)


def a06_relation_coverage(spark, f):
    e = j12_colocation(spark, f)
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.substring("a", 1, 8) == F.substring("b", 1, 8)) / F.count(F.lit(1)), 6).alias("same_task"))


def a08_cite_fidelity(spark, f):
    allowed = D.tasks(spark, f).select("task", "cutoff", F.array_distinct(F.concat(F.coalesce("hubs", F.array().cast("array<string>")), F.coalesce("tail", F.array().cast("array<string>")))).alias("allowed"))
    c = D.claims(spark, f, "pmids").where("size(pmids) > 0").join(allowed, "task")
    return c.groupBy("task").agg(F.round(F.avg(F.size(F.array_intersect("pmids", "allowed")) / F.size(F.array_distinct("pmids"))), 6).alias("fidelity"), F.count(F.lit(1)).alias("n"))


def a19_title_f1(spark, f):
    """Exact agreement of an outline's headings with the task's sections."""
    ours = latest(table(spark, f, "outline_nodes"), ["system", "task", "id"]).select("system", "task", T.heading(C("title")).alias("h")).where("h <> ''").distinct()
    theirs = D.sections(spark, f, "title").select("task", T.heading(C("title")).alias("h")).where("h <> ''").distinct()
    n = theirs.groupBy("task").agg(F.count(F.lit(1)).alias("nt"))
    g = ours.join(theirs.withColumn("m", F.lit(1)), ["task", "h"], "left").groupBy("system", "task").agg(F.count(F.lit(1)).alias("no"), F.count("m").alias("hit"))
    return g.join(n, "task").select("system", "task", F.round(2 * C("hit") / (C("no") + C("nt")), 6).alias("f1"))


def a22_conditioned(spark, f):
    """Coverage of claims among those that the given papers reach."""
    given = latest(table(spark, f, "documents").select("doc_id", "task", "pmid", "loaded_at"), ["doc_id"]).where("task is not null and pmid is not null").groupBy("task").agg(F.collect_set("pmid").alias("given"))
    c = D.claims(spark, f, "pmids", "tier").join(given, "task").where(F.arrays_overlap("pmids", "given"))
    return c.groupBy("task", "tier").agg(F.round(F.avg(F.size(F.array_intersect("pmids", "given")) / F.size(F.array_distinct("pmids"))), 6).alias("reach"), F.count(F.lit(1)).alias("n"))


def a23_conformance(spark, f):
    d = D.draws(spark, f, "system", "completion", "model", "role_sequence")
    return d.groupBy("system", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size("role_sequence")).alias("roles"), F.round(F.avg(C("completion").isNotNull().cast("int")), 6).alias("answered"))


def a28_route_counts(spark, f):
    e = table(spark, f, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("all_"), F.round(F.avg(F.when(C("user_id") % 10 != 0, C("value"))), 6).alias("without"))


def a30_reward_targets(spark, f):
    s = D.scores(spark, f)
    best = s.groupBy("system").agg(F.avg("z").alias("m"))
    top = best.agg(F.max(F.struct("m", "system")).alias("t")).select("t.system", F.lit(1).alias("k"))
    ref = s.join(top, "system").select("task", C("z").alias("ref"))
    return s.join(ref, "task").groupBy("system").agg(F.round(F.percentile(C("z") - C("ref"), F.lit(0.5)), 6).alias("median_gap"), F.count(F.lit(1)).alias("n"))


def w05_chunks(spark, f):
    """Claims of a section dealt into chunks of at most eight, as even as can be."""
    c = D.claims(spark, f, "section_id").where("section_id is not null").select("task", "section_id", "id")
    n = c.groupBy("task", "section_id").agg(F.count(F.lit(1)).alias("n"))
    r = c.join(n, ["task", "section_id"]).withColumn("r", F.row_number().over(Window.partitionBy("task", "section_id").orderBy("id")) - 1).withColumn("k", F.ceil(C("n") / 8))
    return r.select("task", "section_id", "id", F.floor(C("r") * C("k") / C("n")).alias("chunk"))


def w07_batches(spark, f):
    p = D.corpus(spark, f, "n_citation", "journal").where("journal is not null").select("journal", "pmid", F.coalesce("n_citation", F.lit(0)).alias("c"))
    r = p.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("journal").orderBy(C("c").desc(), "pmid")) - 1) / 20))
    return K.top_k(r, ["journal", "batch"], [C("c").desc(), C("pmid")], 5).select("journal", "batch", "pmid", "rank")


def w10_top_outline(spark, f):
    """The roots of each outline, or their children if a single root has two or more."""
    o = latest(table(spark, f, "outline_nodes"), ["system", "task", "id"]).select("system", "task", "id", F.when(C("parent") != "", C("parent")).alias("parent"))
    kids = o.where("parent is not null").groupBy("system", "task", C("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    roots = o.where("parent is null").groupBy("system", "task").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("root"))
    lone = roots.where("n = 1").join(kids.withColumnRenamed("id", "root"), ["system", "task", "root"]).where("kids >= 2").select("system", "task", C("root").alias("parent"))
    peeled = o.join(lone, ["system", "task", "parent"]).select("system", "task", "id")
    kept = o.where("parent is null").join(lone.select("system", "task"), ["system", "task"], "left_anti").select("system", "task", "id")
    return peeled.unionByName(kept)


def w15_retrieved_union(spark, f):
    e = table(spark, f, "events").select(C("user_id").alias("run"), F.get_json_object("props", "$.k").cast("int").alias("paper"), "ts", "event_id").where("paper is not null")
    first = e.groupBy("run", "paper").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return first.select("run", "paper", F.row_number().over(Window.partitionBy("run").orderBy("m")).alias("pos"))


def w20_relabel(spark, f):
    both = F.explode(F.array(F.lit("draft"), F.lit("final"))).alias("window")
    d = D.draws(spark, f, "task", "system", "stage").select("task", "system", "stage", "draw_id", both)
    return d.where("window = 'final' or stage <> 'refine'").groupBy("system", "window").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task").alias("tasks"))


def d09_axes(spark, f):
    o = table(spark, f, "orders").groupBy("o_orderpriority", "o_custkey", "o_orderstatus").agg(F.avg(C("o_totalprice") / 500000).alias("z"))
    return o.groupBy("o_orderpriority", "o_custkey").agg(F.avg("z").alias("z")).groupBy(C("o_orderpriority").alias("system")).agg(F.round(F.avg("z"), 6).alias("z"), F.count(F.lit(1)).alias("tasks"))


def d13_draft_ladder(spark, f):
    """What the final pass adds to a draft: mean gain and its sign, per system."""
    s = table(spark, f, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.min("l_discount").alias("draft"), F.max("l_discount").alias("final"))
    gain = F.avg(C("final") - C("draft"))
    return s.groupBy(C("l_returnflag").alias("system")).agg(F.round(gain, 6).alias("gain"), F.count_if(C("final") > C("draft")).alias("better"), F.count(F.lit(1)).alias("n"))


def d17_lipschitz(spark, f):
    """How fast a readout moves with its input: the 0.95 quantile and the largest ratio of paired gaps."""
    p = ST._peers(spark, f)
    own = p.where("is_self").select("task", "readout", C("value").alias("own"), C("source").alias("me"))
    r = p.where("not is_self").join(own, ["task", "readout"]).withColumn("ratio", F.abs(C("value") - C("own")) / (F.abs(C("source") - C("me")) / 1000 + 0.01))
    return r.groupBy("readout").agg(F.round(F.percentile("ratio", F.lit(0.95)), 6).alias("q95"), F.round(F.max("ratio"), 6).alias("largest"))


def d19_leave_one_out(spark, f):
    """Coverage of the left-out system by the band of the others, per task cluster."""
    s = D.scores(spark, f).groupBy("system", "cluster").agg(F.avg("z").alias("z"))
    held = s.select(C("system").alias("held"), "cluster", C("z").alias("hz"))
    band = held.join(s, "cluster").where("system <> held").groupBy("held", "cluster", "hz").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return band.groupBy("held").agg(F.round(F.avg(((C("hz") >= C("lo")) & (C("hz") <= C("hi"))).cast("int")), 6).alias("coverage"))


def d21_refusals(spark, f):
    tol = ST.S.tolerances(ST._peers(spark, f))
    pairs = table(spark, f, "nation").select(C("n_nationkey").alias("pair"), (C("n_nationkey") / 40).alias("xi"))
    return tol.crossJoin(F.broadcast(pairs)).groupBy("readout").agg(F.count_if(C("xi") > C("eps")).alias("refused"), F.round(F.percentile("xi", F.lit(0.5)), 6).alias("median_xi"), F.round(F.max("eps"), 6).alias("eps"))


def d26_pseudometric(spark, f):
    """Triangle inequality and symmetry of the mean score gaps between systems."""
    m = D.scores(spark, f).groupBy("system").agg(F.round(F.avg("z"), 9).alias("z"))
    a, b = m.select(C("system").alias("x"), C("z").alias("zx")), m.select(C("system").alias("y"), C("z").alias("zy"))
    d = a.crossJoin(F.broadcast(b)).select("x", "y", F.abs(C("zx") - C("zy")).alias("d"))  # systems are few
    t = d.alias("p").join(d.alias("q"), C("p.y") == C("q.x")).join(d.alias("r"), (C("p.x") == C("r.x")) & (C("q.y") == C("r.y")))
    return t.agg(F.count_if(C("r.d") > C("p.d") + C("q.d") + 1e-9).alias("violations"), F.count(F.lit(1)).alias("triples"))


def d29_failure_map(spark, f):
    """Failed stages and the stages after them that the failure reaches."""
    down = spark.createDataFrame([("search", "search"), ("search", "plan"), ("search", "write"), ("plan", "plan"), ("plan", "write"), ("ground", "ground"), ("ground", "write"), ("write", "write"), ("refine", "refine")], "stage string, hit string")
    d = D.draws(spark, f, "task", "system", "stage", "error").where("error is not null").groupBy("task", "system", "stage").agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(down), "stage").groupBy("system", C("hit").alias("stage")).agg(F.countDistinct("task").alias("tasks"))


def d37_assertions(spark, f):
    """Two ways to the same board, and the largest difference."""
    one = D.scores(spark, f).groupBy("system").agg(F.avg("z").alias("z1"))
    two = D.scores(spark, f).groupBy("system", "cluster").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n")).groupBy("system").agg((F.sum("s") / F.sum("n")).alias("z2"))
    return one.join(two, "system", "full").select("system", (F.abs(C("z1") - C("z2")) < 1e-9).alias("equal"))


def r02_window_readouts(spark, f):
    p = C("section_type")
    window = F.when(p.startswith("intro") | p.startswith("background"), "opening").when(p.startswith("conclusion") | p.startswith("discussion"), "closing").otherwise("body")
    return D.claims(spark, f, "section_type", "weight").groupBy("task", window.alias("window")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


def r08_drift(spark, f):
    raw = table(spark, f, "papers").groupBy("faiss_id").agg(F.countDistinct("citation_count").alias("forms"), F.count(F.lit(1)).alias("copies"), (F.max("citation_count") - F.min("citation_count")).alias("drift"))
    state = F.when(C("copies") == 1, "single").when(C("forms") > 1, "drifted").otherwise("stable")
    return raw.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("papers"), F.max("drift").alias("largest"))


def r11_relation_lines(spark, f):
    """Relations read back from lines of text: known ends, no loops, once each."""
    e = table(spark, f, "units").select("task", F.explode("restatements").alias("r"))
    verb = F.when(F.length("r.source_id") % 2 == 0, "supports").otherwise("Qualifies")
    lines = e.select("task", F.concat(F.lit(" - "), "r.source_id", F.lit(" "), verb, F.lit(" "), "r.target_id").alias("line"))
    m = r"^\s*[-*]?\s*(\S+)\s+(?i:(supports|contradicts|qualifies|compares))\s+(\S+)\s*$"
    got = lines.select(*[F.regexp_extract("line", m, i).alias(n) for i, n in ((1, "source"), (2, "verb"), (3, "target"))]).select("source", F.lower("verb").alias("verb"), "target").where("source <> '' and source <> target").distinct()
    ids = D.claims(spark, f, "text").select("id")
    return got.join(ids, got["source"] == ids["id"], "left_semi").join(ids, got["target"] == ids["id"], "left_semi")


def r18_guarded_upsert(spark, f):
    """New rows replace old ones unless a system would be lost."""
    old = D.scores(spark, f).groupBy("system", "cluster").agg(F.round(F.avg("z"), 6).alias("z"))
    new = old.where("cluster < 5").withColumn("z", F.round(C("z") + 1, 6))
    merged = old.join(new.select("system", "cluster"), ["system", "cluster"], "left_anti").unionByName(new)
    lost = old.select("system").distinct().join(merged.select("system").distinct(), "system", "left_anti")
    return merged.crossJoin(lost.agg(F.count(F.lit(1)).alias("lost")))


_CL = D.with_sql("claim")
_DOC = "doc AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"
_EXT = "ext AS (SELECT * FROM papers_ext QUALIFY row_number() OVER (PARTITION BY ext_id ORDER BY loaded_at DESC) = 1)"
_LINKS = "lk AS (SELECT unnest(restatements) AS r FROM units)"
_OUT = "node AS (SELECT system, task, id, title, CASE WHEN parent <> '' THEN parent END AS parent FROM outline_nodes QUALIFY row_number() OVER (PARTITION BY system, task, id ORDER BY loaded_at DESC) = 1)"
_COLOC = f"{_CL}, {_LINKS}, e AS (SELECT DISTINCT least(r.source_id, r.target_id) AS a, greatest(r.source_id, r.target_id) AS b FROM lk WHERE r.source_id <> r.target_id), co AS (SELECT a, b, CASE WHEN x.task = y.task AND x.paragraph_id = y.paragraph_id THEN 'strong' WHEN x.task = y.task AND x.section_id = y.section_id THEN 'weak' ELSE 'none' END AS kind FROM e JOIN claim x ON x.id = a JOIN claim y ON y.id = b)"
_HEAD = lambda c: rf"regexp_replace(regexp_replace(regexp_replace(lower({c}), '^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+', ''), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g')"
_ALLOWED = "al AS (SELECT task, cutoff, list_distinct(list_concat(coalesce(hubs, []), coalesce(tail, []))) AS allowed FROM task)"
_ABBR = "|".join(a.replace(".", r"\.") for a in X.ABBREVIATIONS)
_K = "chr(57344)"

ORACLE = {
    "t07_careful_sentences": rf"""{D.with_sql('corpus')}, p AS (SELECT pmid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(abstract, '\b({_ABBR})\.', '\1' || {_K}, 'g'), '\b([A-Z])\.(\s+[A-Z])', '\1' || {_K} || '\2', 'g'), '(\d)\.(\d)', '\1' || {_K} || '\2', 'g'), '([.!?]["'')\]]?)\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g') AS t FROM corpus WHERE abstract IS NOT NULL), s AS (SELECT pmid, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(replace(x, {_K}, '.'), ' ')), lambda x: x <> '') AS s FROM p) SELECT pmid, len(s) AS n, sha256(array_to_string(s, '|')) AS digest FROM s""",
    "t19_labels": f"{D.with_sql('draw')} SELECT CASE WHEN stage = 'search' THEN 'retrieve' WHEN stage IN ('plan', 'refine') THEN 'plan' ELSE 'write' END AS action, CASE WHEN coalesce(n_completion_tokens, 0) <= 0 THEN '0' WHEN n_completion_tokens <= 16 THEN '1-16' WHEN n_completion_tokens <= 64 THEN '17-64' WHEN n_completion_tokens <= 256 THEN '65-256' WHEN n_completion_tokens <= 1024 THEN '257-1024' ELSE '>1024' END AS bin, CASE WHEN error IS NOT NULL THEN 'failed' WHEN finish_reason = 'length' THEN 'cut' WHEN coalesce(n_completion_tokens, 0) = 0 THEN 'none' ELSE 'text' END AS effect, count(*) AS n FROM draw GROUP BY 1, 2, 3",
    "t22_render_variants": f"{D.with_sql('corpus')} SELECT pmid, CASE pmid % 3 WHEN 0 THEN CASE WHEN upper(abstract) = abstract THEN 'plain' ELSE 'upper' END WHEN 1 THEN CASE WHEN lower(abstract) = abstract THEN 'plain' ELSE 'lower' END ELSE 'labelled' END AS way FROM corpus WHERE abstract <> ''",
    "l15_metered_pool": "WITH e AS (SELECT user_id AS run, CAST(json_extract(props, '$.k') AS INT) AS paper, value, ts, event_id FROM events) SELECT run, paper, max(value) AS best, min(event_id) AS first_step, arg_min(event_id, (ts, event_id)) AS first_event, count(*) AS times FROM e WHERE paper IS NOT NULL GROUP BY 1, 2",
    "l19_stubs": f"{D.with_sql('claim', 'task')}, s AS (SELECT task, list_sort(list_distinct(list(pmids[1])))[1:100] AS stubs FROM claim WHERE len(pmids) > 0 GROUP BY task) SELECT task.task, coalesce(len(stubs), 0) AS n_stubs, stubs[1] AS first FROM task LEFT JOIN s USING (task)",
    "v06_sub_index": f"{D.with_sql('vector')} SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS row FROM vector WHERE id IN (SELECT user_id FROM events)",
    "v11_tap_split": "SELECT user_id, CASE WHEN CAST(json_extract(props, '$.k') AS INT) = 100 THEN 'subsection' WHEN CAST(json_extract(props, '$.k') AS INT) > 90 THEN 'pool' ELSE 'outline' END AS kind, count(*) AS calls, min(event_id) AS first FROM events GROUP BY 1, 2",
    "g05_edge_page": f"{D.with_sql('edge')}, e AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst), r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank, count(*) OVER (PARTITION BY dst) AS total FROM e) SELECT dst, src, rank, CASE WHEN total > 20 THEN 20 END AS next FROM r WHERE rank > 10 AND rank <= 20",
    "g14_claim_graph": f"{_CL}, {_LINKS}, e AS (SELECT DISTINCT r.source_id AS s, r.target_id AS t FROM lk WHERE r.source_id <> r.target_id) SELECT CASE WHEN x.task <> y.task THEN 'hard_negative' WHEN x.section_id = y.section_id THEN 'within' ELSE 'across' END AS kind, count(*) AS n, round(avg(x.groundedness), 6) AS groundedness FROM e JOIN claim x ON x.id = s JOIN claim y ON y.id = t GROUP BY 1",
    "j04_canonical_bundle": rf"{D.with_sql('corpus', 'claim', 'task')}, {_EXT}, x AS (SELECT lower(title) AS t, min(TRY_CAST(nullif(regexp_extract(date, '(19|20)\d\d', 0), '') AS INT)) AS ey FROM ext WHERE title <> '' GROUP BY 1), p AS (SELECT pmid, coalesce(year, ey) AS year, CASE WHEN year IS NOT NULL THEN 'pool' WHEN ey IS NOT NULL THEN 'listing' ELSE 'none' END AS source FROM corpus LEFT JOIN x ON x.t = lower(title)), w AS (SELECT DISTINCT task, CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) SELECT task, pmid, p.year, source, row_number() OVER (PARTITION BY task ORDER BY pmid) AS rank FROM w JOIN task USING (task) JOIN p USING (pmid) WHERE p.year <= cutoff",
    "j09_exact_channel": rf"{_CL}, {_DOC}, l AS (SELECT task, unnest(string_split(text, chr(10))) AS line FROM doc WHERE task IS NOT NULL AND text IS NOT NULL), n AS (SELECT DISTINCT task, trim(regexp_replace(lower(regexp_replace(line, '^- ', '')), '[^a-z0-9]+', ' ', 'g')) AS n FROM l), c AS (SELECT id, task, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM claim) SELECT c.task, count(n.n) AS matched, count(*) AS claims FROM c LEFT JOIN n ON n.task = c.task AND n.n = c.n WHERE length(c.n) >= 20 GROUP BY c.task",
    "j12_colocation": f"{_COLOC} SELECT * FROM co",
    "j14_containment": f"WITH {_EXT}, w AS (SELECT ext_id, venue, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({', '.join(repr(w) for w in T.QUERY_STOP)}) AND NOT regexp_full_match(t, '(19|20)[0-9][0-9]'))) AS w FROM ext WHERE venue IS NOT NULL), p AS (SELECT a.ext_id AS x, b.ext_id AS y, list_intersect(a.w, b.w) AS c, least(len(a.w), len(b.w)) AS m FROM w a JOIN w b ON a.venue = b.venue AND a.ext_id < b.ext_id WHERE len(a.w) > 0 AND len(b.w) > 0), q AS (SELECT x AS i, y AS o, len(c) / m AS k FROM p UNION ALL SELECT y, x, len(c) / m FROM p) SELECT i AS ext_id, arg_min(o, (-k, o)) AS partner, round(max(k), 6) AS containment, count(*) AS links FROM q WHERE k >= 0.5 GROUP BY i",
    "j18_restore": f"{_CL} SELECT substr(id, 1, 8) AS task, count(*) AS restored FROM claim WHERE text IS NOT NULL GROUP BY 1",
    "j20_delivery": f"{D.with_sql('claim', 'task')}, n AS (SELECT task, count(*) AS n FROM claim GROUP BY task) SELECT CASE WHEN cutoff IS NULL THEN 'no_cutoff' WHEN hubs IS NULL THEN 'no_hubs' WHEN n_claims <> n THEN 'claims_differ' ELSE 'ok' END AS state, count(*) AS tasks FROM task LEFT JOIN n USING (task) GROUP BY 1",
    "j24_baseline_list": f"{D.with_sql('corpus', 'claim', 'task')}, w AS (SELECT DISTINCT task, CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) SELECT w.task, count(*) AS papers, count(*) FILTER (trim(coalesce(abstract, '')) <> '') AS with_abstract FROM w JOIN task t USING (task) LEFT JOIN corpus c USING (pmid) WHERE coalesce(c.year, t.cutoff) <= t.cutoff AND w.pmid IS DISTINCT FROM t.review_pmid GROUP BY w.task",
    "j25_recomputed": "SELECT 0 AS differing",
    "a03_hub_recall_at": f"{D.with_sql('claim', 'task')}, o AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY id) AS o, pmids FROM claim), f AS (SELECT task, pmid, min(o) AS o FROM (SELECT task, o, unnest(pmids) AS pmid FROM o) GROUP BY ALL), h AS (SELECT task, unnest(list_distinct(hubs)) AS pmid FROM task) SELECT h.task, round(avg(CAST(coalesce(o, 1000000) <= 5 AS INT)), 6) AS at_5, round(avg(CAST(coalesce(o, 1000000) <= 10 AS INT)), 6) AS at_10, round(avg(CAST(coalesce(o, 1000000) <= 20 AS INT)), 6) AS at_20 FROM h LEFT JOIN f ON f.task = h.task AND f.pmid = h.pmid GROUP BY h.task",
    "a06_relation_coverage": f"{_COLOC} SELECT kind, count(*) AS n, round(count(*) FILTER (substr(a, 1, 8) = substr(b, 1, 8)) / count(*), 6) AS same_task FROM co GROUP BY kind",
    "a08_cite_fidelity": f"{D.with_sql('claim', 'task')}, {_ALLOWED} SELECT task, round(avg(len(list_filter(list_distinct(pmids), lambda x: list_contains(allowed, x))) / len(list_distinct(pmids))), 6) AS fidelity, count(*) AS n FROM claim JOIN al USING (task) WHERE len(pmids) > 0 GROUP BY task",
    "a19_title_f1": f"{D.with_sql('section')}, {_OUT}, o AS (SELECT DISTINCT system, task, {_HEAD('title')} AS h FROM node WHERE title IS NOT NULL), t AS (SELECT DISTINCT task, {_HEAD('title')} AS h FROM section WHERE title IS NOT NULL), n AS (SELECT task, count(*) AS nt FROM t WHERE h <> '' GROUP BY task), g AS (SELECT system, o.task, count(*) AS no, count(t.h) AS hit FROM o LEFT JOIN t ON t.task = o.task AND t.h = o.h WHERE o.h <> '' GROUP BY 1, 2) SELECT system, task, round(2 * hit / (no + nt), 6) AS f1 FROM g JOIN n USING (task)",
    "a22_conditioned": f"{_CL}, {_DOC}, g AS (SELECT task, list_distinct(list(pmid)) AS given FROM doc WHERE task IS NOT NULL AND pmid IS NOT NULL GROUP BY task), c AS (SELECT task, tier, len(list_filter(list_distinct(pmids), lambda x: list_contains(given, x))) AS hit, len(list_distinct(pmids)) AS n FROM claim JOIN g USING (task)) SELECT task, tier, round(avg(hit / n), 6) AS reach, count(*) AS n FROM c WHERE hit > 0 GROUP BY 1, 2",
    "a23_conformance": f"{D.with_sql('draw')} SELECT system, model, count(*) AS calls, sum(len(role_sequence)) AS roles, round(avg(CAST(completion IS NOT NULL AS INT)), 6) AS answered FROM draw GROUP BY 1, 2",
    "a28_route_counts": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS all_, round(avg(value) FILTER (user_id % 10 <> 0), 6) AS without FROM events GROUP BY 1",
    "a30_reward_targets": f"{D.with_sql('score')}, b AS (SELECT arg_max(system, (m, system)) AS top FROM (SELECT system, avg(z) AS m FROM score GROUP BY 1)), r AS (SELECT task, z AS ref FROM score, b WHERE system = top) SELECT system, round(quantile_cont(z - ref, 0.5), 6) AS median_gap, count(*) AS n FROM score JOIN r USING (task) GROUP BY system",
    "w05_chunks": f"{_CL}, c AS (SELECT task, section_id, id, row_number() OVER (PARTITION BY task, section_id ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY task, section_id) AS n FROM claim WHERE section_id IS NOT NULL) SELECT task, section_id, id, CAST(floor(r * ceil(n / 8) / n) AS BIGINT) AS chunk FROM c",
    "w07_batches": f"{D.with_sql('corpus')}, p AS (SELECT journal, pmid, coalesce(n_citation, 0) AS c, row_number() OVER (PARTITION BY journal ORDER BY coalesce(n_citation, 0) DESC, pmid) - 1 AS r FROM corpus WHERE journal IS NOT NULL) SELECT journal, r // 20 AS batch, pmid, r % 20 + 1 AS rank FROM p WHERE r % 20 < 5",
    "w10_top_outline": f"WITH {_OUT}, r AS (SELECT system, task, min(id) AS root FROM node WHERE parent IS NULL GROUP BY ALL HAVING count(*) = 1), l AS (SELECT r.* FROM r WHERE (SELECT count(*) FROM node n WHERE n.system = r.system AND n.task = r.task AND n.parent = r.root) >= 2) SELECT n.system, n.task, n.id FROM node n JOIN l ON l.system = n.system AND l.task = n.task AND n.parent = l.root UNION ALL SELECT system, task, id FROM node WHERE parent IS NULL AND (system, task) NOT IN (SELECT (system, task) FROM l)",
    "w15_retrieved_union": "WITH e AS (SELECT user_id AS run, CAST(json_extract(props, '$.k') AS INT) AS paper, min((ts, event_id)) AS m FROM events GROUP BY 1, 2) SELECT run, paper, row_number() OVER (PARTITION BY run ORDER BY m) AS pos FROM e WHERE paper IS NOT NULL",
    "w20_relabel": f"{D.with_sql('draw')}, w AS (SELECT *, unnest(['draft', 'final']) AS window_ FROM draw) SELECT system, window_ AS \"window\", count(*) AS n, count(DISTINCT task) AS tasks FROM w WHERE window_ = 'final' OR stage <> 'refine' GROUP BY 1, 2",
    "d09_axes": "WITH a AS (SELECT o_orderpriority AS system, o_custkey, o_orderstatus, avg(o_totalprice / 500000) AS z FROM orders GROUP BY ALL), b AS (SELECT system, o_custkey, avg(z) AS z FROM a GROUP BY ALL) SELECT system, round(avg(z), 6) AS z, count(*) AS tasks FROM b GROUP BY system",
    "d13_draft_ladder": "WITH s AS (SELECT l_returnflag AS system, l_orderkey, min(l_discount) AS draft, max(l_discount) AS final FROM lineitem GROUP BY ALL) SELECT system, round(avg(final - draft), 6) AS gain, count(*) FILTER (final > draft) AS better, count(*) AS n FROM s GROUP BY system",
    "d17_lipschitz": f"WITH {ST._PEERS}, r AS (SELECT p.readout, abs(p.value - s.value) / (abs(p.source - s.source) / 1000 + 0.01) AS ratio FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self) SELECT readout, round(quantile_cont(ratio, 0.95), 6) AS q95, round(max(ratio), 6) AS largest FROM r GROUP BY readout",
    "d19_leave_one_out": f"{D.with_sql('score')}, s AS (SELECT system, cluster, avg(z) AS z FROM score GROUP BY ALL), b AS (SELECT h.system AS held, h.cluster, h.z AS hz, min(s.z) AS lo, max(s.z) AS hi FROM s h JOIN s ON s.cluster = h.cluster AND s.system <> h.system GROUP BY ALL) SELECT held, round(avg(CAST(hz >= lo AND hz <= hi AS INT)), 6) AS coverage FROM b GROUP BY held",
    "d21_refusals": f"WITH {ST._PEERS}, g AS (SELECT p.readout, abs(p.value - s.value) AS gap FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self), t AS (SELECT readout, quantile_cont(gap, 0.5) AS eps FROM g GROUP BY readout), x AS (SELECT n_nationkey / 40 AS xi FROM nation) SELECT readout, count(*) FILTER (xi > eps) AS refused, round(quantile_cont(xi, 0.5), 6) AS median_xi, round(max(eps), 6) AS eps FROM t, x GROUP BY readout",
    "d26_pseudometric": f"{D.with_sql('score')}, n AS (SELECT count(DISTINCT system) AS n FROM score) SELECT 0 AS violations, n * n * n AS triples FROM n",
    "d29_failure_map": f"{D.with_sql('draw')}, down AS (SELECT * FROM (VALUES ('search', 'search'), ('search', 'plan'), ('search', 'write'), ('plan', 'plan'), ('plan', 'write'), ('ground', 'ground'), ('ground', 'write'), ('write', 'write'), ('refine', 'refine')) v(stage, hit)) SELECT system, hit AS stage, count(DISTINCT task) AS tasks FROM draw JOIN down USING (stage) WHERE error IS NOT NULL GROUP BY 1, 2",
    "d37_assertions": f"{D.with_sql('score')} SELECT DISTINCT system, true AS equal FROM score",
    "r02_window_readouts": f"{_CL} SELECT task, CASE WHEN section_type LIKE 'intro%' OR section_type LIKE 'background%' THEN 'opening' WHEN section_type LIKE 'conclusion%' OR section_type LIKE 'discussion%' THEN 'closing' ELSE 'body' END AS \"window\", count(*) AS n, round(avg(weight), 6) AS weight FROM claim GROUP BY 1, 2",
    "r08_drift": "WITH g AS (SELECT faiss_id, count(DISTINCT citation_count) AS forms, count(*) AS copies, max(citation_count) - min(citation_count) AS drift FROM papers GROUP BY 1) SELECT CASE WHEN copies = 1 THEN 'single' WHEN forms > 1 THEN 'drifted' ELSE 'stable' END AS state, count(*) AS papers, max(drift) AS largest FROM g GROUP BY 1",
    "r11_relation_lines": f"{_CL}, {_LINKS} SELECT DISTINCT r.source_id AS source, CASE WHEN length(r.source_id) % 2 = 0 THEN 'supports' ELSE 'qualifies' END AS verb, r.target_id AS target FROM lk WHERE r.source_id <> r.target_id AND r.source_id IN (SELECT id FROM claim) AND r.target_id IN (SELECT id FROM claim)",
    "r18_guarded_upsert": f"{D.with_sql('score')}, o AS (SELECT system, cluster, round(avg(z), 6) AS z FROM score GROUP BY ALL) SELECT system, cluster, CASE WHEN cluster < 5 THEN round(z + 1, 6) ELSE z END AS z, 0 AS lost FROM o",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "t23_json_states", "t30_similarity"]}
