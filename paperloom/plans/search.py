"""Queries of the index, of vector search and of graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.snippets import best_window
from paperloom.operators import blocks as K
from paperloom.operators import graph as G
from paperloom.operators import lexical as L
from paperloom.operators import vectors as V
from paperloom.operators.ranking import first_wins
from paperloom.session import Workspace
from paperloom.sources import domain as D
from paperloom.sources.tables import table

C = F.col
DEPTH = 10


def _tokens():
    return T.pool_tokens(F.concat_ws(" ", "title", "abstract"))


def _index(spark, f):
    corpus = D.corpus(spark, f, "title", "abstract", "year")
    return L.index(corpus, "pmid", _tokens()), corpus.select("pmid", "year")


def _packed(spark, f, *carried):
    """The corpus by blocks, for searches."""
    return K.pack(D.corpus(spark, f, "title", "abstract", "year", *carried), "pmid", "year", F.array("title", "abstract"), *carried)


def l01_document_frequency(spark, f):
    counts = L.term_counts(D.corpus(spark, f, "title", "abstract"), "pmid", _tokens())
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def l02_vocabulary(spark, f):
    corpus = D.corpus(spark, f, "title", "abstract")
    terms = L.vocabulary(L.term_counts(corpus, "pmid", _tokens()), "pmid", corpus.count())
    return terms.select("term", "df", F.round("idf", 9).alias("idf"))


def l04_postings(spark, f):
    posts, _ = _index(spark, f)
    return posts.select("term", "pmid", "tf", F.round("impact", 6).alias("impact"))


def l05_pmid_table(spark, f):
    raw = table(spark, f, "papers").select("pmid", "faiss_id", "loaded_at")
    first = first_wins(raw, ["pmid"], [C("loaded_at"), C("faiss_id")])
    return first.join(raw.groupBy("pmid").agg(F.count(F.lit(1)).alias("copies")), "pmid").select("pmid", "faiss_id", "copies")


def l07_search(spark, f):
    return K.search(_packed(spark, f), D.queries(spark, f), T.pool_tokens(C("query")), "pmid", DEPTH)


def l08_lookup(spark, f):
    wanted = D.claims(spark, f, "pmids").select(F.explode("pmids").alias("p")).select(C("p").cast("long").alias("pmid")).distinct()
    return wanted.join(D.corpus(spark, f, "title", "year").select("pmid", "title", "year"), "pmid", "left").select("pmid", "year", C("title").isNotNull().alias("found"))


def l09_allowlisted_search(spark, f):
    listed = D.tasks(spark, f).select(C("task").alias("qid"), F.array_union(F.coalesce("hubs", F.array().cast("array<string>")), F.coalesce("tail", F.array().cast("array<string>"))).cast("array<long>").alias("listed"))
    scored = K.listed_scores(_packed(spark, f), D.queries(spark, f).join(listed, "qid"), T.pool_tokens(C("query")), "listed", "pmid")
    return L.ranked_list(scored, "pmid")


def l10_visibility(spark, f):
    cited = D.claims(spark, f, "pmids").select("task", F.explode("pmids").alias("p")).select("task", C("p").cast("long").alias("pmid")).distinct()
    joined = cited.join(D.tasks(spark, f).select("task", "cutoff", "review_pmid"), "task").join(D.corpus(spark, f, "year").select("pmid", "year"), "pmid", "left")
    by_id = L.visible(C("year"), C("cutoff")) & ~C("pmid").eqNullSafe(C("review_pmid"))
    return joined.groupBy("task").agg(F.count_if(by_id).alias("visible"), F.count_if(L.searchable(C("year"), C("cutoff"))).alias("searchable"), F.count(F.lit(1)).alias("cited"))


def l11_page(spark, f):
    return L.page(K.search(_packed(spark, f), D.queries(spark, f), T.pool_tokens(C("query")), "pmid", 20), 5, 5)


def l12_batch_get(spark, f):
    asked = D.claims(spark, f, "pmids").where("size(pmids) > 0").select("id", F.posexplode("pmids").alias("at", "p"))
    got = asked.join(D.corpus(spark, f, "year").select(C("pmid").cast("string").alias("p"), "year"), "p", "left")
    return got.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "year"))), lambda r: r["year"]).alias("years"))


def l13_best_sentence(spark, f):
    """The best sentence of every hit to the depth of the snippet search; the earliest of equals."""
    parts = F.concat(F.array("title"), F.coalesce(T.loose_sentences(C("abstract")), F.array().cast("array<string>")))
    packed = K.pack(D.corpus(spark, f, "title", "abstract", "year"), "pmid", "year", parts, keep_parts=True)
    return K.best_parts(packed, D.queries(spark, f), T.pool_tokens(C("query")), "pmid", max(20 * DEPTH, 200))


def l13_snippets(spark, f):
    """What a snippet search shows of the best hits of every query: best sentence and the neighbours that fit."""
    queries = D.queries(spark, f)
    hits = K.search(_packed(spark, f, "row"), queries, T.pool_tokens(C("query")), "pmid", DEPTH, "ref").select("qid", "rank", C("ref").alias("row"))
    # The rows' own key joins the corpus where the choice of the latest rows has put it.
    asked = hits.join(queries.select("qid", T.pool_tokens(C("query")).alias("q")), "qid").join(D.corpus(spark, f, "abstract", "row"), "row")

    def show(batches):
        for pdf in batches:
            found = [best_window(t, q) or (None, None) for t, q in zip(pdf["abstract"], pdf["q"])]
            yield pd.DataFrame({"qid": pdf["qid"], "pmid": pdf["pmid"], "rank": pdf["rank"], "start": pd.array([a for a, _ in found], "Int64"), "end_": pd.array([b for _, b in found], "Int64")})

    return asked.select("qid", "pmid", "rank", "abstract", "q").mapInPandas(show, "qid string, pmid long, rank int, start long, end_ long")


def l14_metered(spark, f):
    """What of the ten best of each query is delivered if the queries of a cutoff, in order of id, may read 25 papers in all."""
    hits = Workspace(spark, "hits").write(l07_search(spark, f))
    calls = D.queries(spark, f).where("cutoff is not null").select("qid", C("cutoff").alias("run"))
    return L.metered(hits.join(calls, "qid").select("run", "qid", "pmid", "rank"), "run", "qid", "pmid", 25)


def l14_normalised_scores(spark, f):
    top = F.max("score").over(Window.partitionBy("qid"))
    return l07_search(spark, f).select("qid", "pmid", F.round(0.9 * C("score") / top, 6).alias("relevance"))


def l16_cutoff_sample(spark, f):
    return D.corpus(spark, f, "year").where("year is not null").groupBy("year").agg(F.min("pmid").alias("pmid"), F.count(F.lit(1)).alias("n"))


def l17_freeze(spark, f):
    corpus = D.corpus(spark, f, "year").select("pmid", "year")
    gold = D.tasks(spark, f).select(C("review_pmid").alias("pmid")).where("pmid is not null").distinct()
    cited = D.claims(spark, f, "pmids").join(D.tasks(spark, f).select("task", "cutoff"), "task").select(F.explode("pmids").alias("p"), "cutoff").groupBy(C("p").cast("long").alias("pmid")).agg(F.min("cutoff").alias("fallback"))
    extra = cited.join(corpus, "pmid", "left_anti").select("pmid", C("fallback").alias("year"))
    pool = corpus.join(gold, "pmid", "left_anti").unionByName(extra.join(gold, "pmid", "left_anti"))
    return pool.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("pmid").alias("first"))


def l18_review_map(spark, f):
    return D.tasks(spark, f).select("task", "review_pmid", C("review_pmid").isNull().alias("fatal"))


def _vectors(spark, f):
    return D.vectors(spark, f)


def _vector_queries(spark, f):
    """Every vector whose id is divisible by 100, against all."""
    return _vectors(spark, f).where("id % 100 = 0").select(C("id").alias("qid"), "embedding")


def v02_nearest_cosine(spark, f):
    return V.nearest(_vectors(spark, f), _vector_queries(spark, f), 10).select("qid", "id", "score")


def v02_nearest_l2(spark, f):
    return V.nearest(_vectors(spark, f), _vector_queries(spark, f), 10, "l2").select("qid", "id", (0 - C("score")).alias("distance"))


def v03_cutoff_views(spark, f):
    cuts = D.tasks(spark, f).select("task", "cutoff", "review_pmid")
    years = D.corpus(spark, f, "year").groupBy("year").agg(F.count(F.lit(1)).alias("n")).where("year > 0")
    sizes = cuts.join(F.broadcast(years), years["year"] <= cuts["cutoff"], "left").groupBy("task", "cutoff", "review_pmid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    own = D.corpus(spark, f, "year").select(C("pmid").alias("review_pmid"), C("year").alias("ry"))
    return sizes.join(own, "review_pmid", "left").select("task", (C("n") - F.coalesce((C("ry") <= C("cutoff")).cast("int"), F.lit(0))).alias("view_size"))


def v04_filtered_nearest(spark, f):
    inside = _vectors(spark, f).where("year is not null and year <= 2012")
    return V.nearest(inside, _vector_queries(spark, f), 5).select("qid", "id", "score")


def v07_merge_metadata(spark, f):
    ext = table(spark, f, "papers_ext").groupBy("doi").agg(F.max("citation_count").alias("ext_citations"))
    joined = D.corpus(spark, f, "doi").where("doi <> ''").join(ext, "doi", "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(C("ext_citations").isNotNull()).alias("hits"), F.count_if(C("ext_citations").isNull()).alias("misses"))


def v09_candidate_pairs(spark, f):
    """Every vector proposes within its label; the table has no paragraphs, so each vector is one."""
    return V.candidate_pairs(_vectors(spark, f).withColumn("part", C("id")), "label", "part", 6, 0.45)


def g01_clean_edges(spark, f):
    return G.edge_counts(D.edges(spark, f))


def g02_adjacency(spark, f):
    """A node has one row for each block of its neighbours; the first neighbours order the blocks."""
    return G.adjacency_blocks(G.clean_edges(D.edges(spark, f)), "dst", "src").select("dst", "degree", "neighbours")


def g03_citation_counts(spark, f):
    known = table(spark, f, "supplier").select(C("s_suppkey").alias("id"), F.when(C("s_suppkey") % 3 == 0, C("s_suppkey").cast("int")).alias("n_citation"))
    return G.citation_counts(G.clean_edges(D.edges(spark, f)), known, "id")


def _years(spark, f):
    return table(spark, f, "part").select(C("p_partkey").alias("id"), F.when(C("p_partkey") % 17 != 0, (2000 + C("p_partkey") % 26).cast("int")).alias("year"))


def g04_visible_neighbours(spark, f):
    asked = table(spark, f, "part").select(C("p_partkey").alias("qid"), C("p_partkey").alias("id"), (2005 + C("p_partkey") % 20).alias("cutoff"), (C("p_partkey") % 100).alias("review"))
    return G.visible_neighbours(G.clean_edges(D.edges(spark, f)), _years(spark, f), asked)


def g06_authority(spark, f):
    cand = table(spark, f, "supplier").select(F.lit(1).alias("qid"), C("s_suppkey").alias("id"), F.lit(2015).alias("cutoff"))
    return G.authority(G.clean_edges(D.edges(spark, f)), _years(spark, f), cand)


def g08_paths(spark, f):
    e = D.claims(spark, f, "pmids", "tier").where("size(pmids) >= 2").select(C("pmids")[0].alias("src"), C("pmids")[1].alias("dst"), "tier", "id").where("src <> dst")
    folded = e.groupBy("src", "dst").agg(F.max_by("tier", "id").alias("type"))
    paths = G.two_hop_paths(folded)
    kind = F.when((C("first") == "core") & (C("second") == "core"), "chain").when((C("first") == "core") | (C("second") == "core"), "mixed").otherwise("other")
    return paths.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("starts"))


def g08_motifs(spark, f):
    """Chains and mechanism paths over the restatements of a task, typed by the tier of the claim they lead to."""
    links = table(spark, f, "units").select("task", F.posexplode("restatements").alias("at", "r")).select("task", "at", C("r.source_id").alias("src"), C("r.target_id").alias("dst"))
    tier = F.when(C("tier") == "core", "elaboration").when(C("tier") == "support", "mechanism").otherwise("evidence")
    typed = links.join(D.claims(spark, f, "tier").select(C("id").alias("dst"), tier.alias("type")), "dst")
    kinds = F.when((C("first") == "elaboration") & (C("second") == "elaboration"), "chain").when((C("first") == "mechanism") | (C("second") == "mechanism"), "mechanism_path")
    return G.motif_paths(typed, "task", kinds)


def g15_citation_weight(spark, f):
    return D.claims(spark, f, "pmids", "weight").select("task", F.explode(F.array_distinct("pmids")).alias("pmid")).groupBy("task", "pmid").agg(F.count(F.lit(1)).alias("weight"))


_INDEX = f"""{D.with_sql('corpus', 'section', 'task', 'query')},
tok AS (SELECT pmid, year, list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(f"'{w}'" for w in T.POOL_STOP)})) AS tokens FROM corpus),
stat AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM tok),
cnt AS (SELECT pmid, term, count(*) AS tf FROM (SELECT pmid, unnest(tokens) AS term FROM tok) GROUP BY ALL),
voc AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM cnt GROUP BY term), stat WHERE df <= floor(0.30 * n)),
post AS (SELECT term, c.pmid, tf, idf * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * len(tokens) / mean)) AS impact FROM cnt c JOIN voc USING (term) JOIN tok t ON t.pmid = c.pmid, stat)"""
_HITS = f"""{_INDEX},
qt AS (SELECT qid, cutoff, review_pmid, term, count(*) AS qtf FROM (SELECT qid, cutoff, review_pmid, unnest(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(f"'{w}'" for w in T.POOL_STOP)}))) AS term FROM query) GROUP BY ALL),
hit AS (SELECT s.qid, s.pmid, s.score FROM (SELECT qid, cutoff, review_pmid, pmid, round(sum(qtf * impact), 6) AS score FROM qt JOIN post USING (term) GROUP BY ALL) s JOIN corpus c USING (pmid) WHERE (c.year IS NULL OR c.year <= s.cutoff) AND s.pmid IS DISTINCT FROM s.review_pmid),
best AS (SELECT qid, pmid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pmid) AS rank, count(*) OVER (PARTITION BY qid) AS total FROM hit)"""
_COS = "list_dot_product(q.embedding, v.embedding) / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(v.embedding, v.embedding)))"
_COS = _COS.replace("q.embedding", "q.e").replace("v.embedding", "v.e")
_VEC = f"{D.with_sql('vector')}, v AS (SELECT id, year, embedding::DOUBLE[] AS e FROM vector), q AS (SELECT id AS qid, e FROM v WHERE id % 100 = 0)"
_EDGES = f"{D.with_sql('edge')}, e AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst)"

ORACLE = {
    "l01_document_frequency": f"{_INDEX} SELECT term, count(*) AS df, sum(tf) AS cf FROM cnt GROUP BY term",
    "l02_vocabulary": f"{_INDEX} SELECT term, df, round(idf, 9) AS idf FROM voc",
    "l04_postings": f"{_INDEX} SELECT term, pmid, tf, round(impact, 6) AS impact FROM post",
    "l05_pmid_table": "SELECT pmid, arg_min(faiss_id, (loaded_at, faiss_id)) AS faiss_id, count(*) AS copies FROM papers GROUP BY pmid",
    "l07_search": f"{_HITS} SELECT * FROM best WHERE rank <= 10",
    "l08_lookup": f"{D.with_sql('corpus', 'claim')}, w AS (SELECT DISTINCT CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) SELECT w.pmid, c.year, c.title IS NOT NULL AS found FROM w LEFT JOIN corpus c USING (pmid)",
    "l09_allowlisted_search": f"{_HITS}, al AS (SELECT DISTINCT q.qid, CAST(p AS BIGINT) AS pmid, q.cutoff, q.review_pmid FROM query q JOIN (SELECT task, unnest(list_concat(coalesce(hubs, []), coalesce(tail, []))) AS p FROM task) t ON t.task = q.qid), ok AS (SELECT qid, a.pmid FROM al a JOIN corpus c USING (pmid) WHERE (c.year IS NULL OR c.year <= a.cutoff) AND a.pmid IS DISTINCT FROM a.review_pmid) SELECT qid, o.pmid, coalesce(h.score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY h.score IS NULL, h.score DESC, o.pmid) AS rank FROM ok o LEFT JOIN hit h USING (qid, pmid)",
    "l10_visibility": f"{D.with_sql('corpus', 'claim', 'task')}, w AS (SELECT DISTINCT task, CAST(unnest(pmids) AS BIGINT) AS pmid FROM claim) SELECT w.task, count(*) FILTER (c.year <= t.cutoff AND w.pmid IS DISTINCT FROM t.review_pmid) AS visible, count(*) FILTER (c.year IS NULL OR c.year <= t.cutoff) AS searchable, count(*) AS cited FROM w JOIN task t USING (task) LEFT JOIN corpus c USING (pmid) GROUP BY w.task",
    "l11_page": f"{_HITS} SELECT qid, pmid, score, rank, total, CASE WHEN total > 10 THEN 10 END AS next FROM best WHERE rank > 5 AND rank <= 10",
    "l12_batch_get": f"{D.with_sql('corpus', 'claim')}, a AS (SELECT id, generate_subscripts(pmids, 1) AS at_, unnest(pmids) AS p FROM claim) SELECT id, list(c.year ORDER BY at_) AS years FROM a LEFT JOIN corpus c ON CAST(c.pmid AS VARCHAR) = a.p GROUP BY id",
    "l13_best_sentence": rf"""{_HITS}, s AS (SELECT pmid, unnest(range(len(x))) AS k, unnest(x) AS s FROM (SELECT pmid, list_filter(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '') AS x FROM corpus)),
tk AS (SELECT q.qid, s.pmid, s.k, list_distinct(list_filter(regexp_extract_all(lower(s.s), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(f"'{w}'" for w in T.POOL_STOP)}))) AS a, list_filter(regexp_extract_all(lower(q.query), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({', '.join(f"'{w}'" for w in T.POOL_STOP)})) AS b FROM s JOIN best h ON h.pmid = s.pmid AND h.rank <= 200 JOIN query q ON q.qid = h.qid),
o AS (SELECT qid, pmid, k, len(list_filter(a, lambda t: list_contains(b, t))) AS overlap FROM tk)
SELECT qid, pmid, arg_max(k, (overlap, -k)) AS k, max(overlap) AS overlap FROM o GROUP BY qid, pmid""",
    "l14_metered": f"{_HITS}, c AS (SELECT q.cutoff AS run, b.qid, b.pmid, b.rank FROM best b JOIN query q USING (qid) WHERE b.rank <= 10 AND q.cutoff IS NOT NULL), o AS (SELECT run, pmid, min((qid, rank)) AS at_ FROM c GROUP BY 1, 2), k AS (SELECT run, pmid FROM o QUALIFY row_number() OVER (PARTITION BY run ORDER BY at_) <= 25) SELECT run, qid, pmid, rank FROM c JOIN k USING (run, pmid)",
    "l14_normalised_scores": f"{_HITS} SELECT qid, pmid, round(0.9 * score / max(score) OVER (PARTITION BY qid), 6) AS relevance FROM best WHERE rank <= 10",
    "l16_cutoff_sample": f"{D.with_sql('corpus')} SELECT year, min(pmid) AS pmid, count(*) AS n FROM corpus WHERE year IS NOT NULL GROUP BY year",
    "l17_freeze": f"{D.with_sql('corpus', 'claim', 'task')}, gold AS (SELECT DISTINCT review_pmid AS pmid FROM task WHERE review_pmid IS NOT NULL), ct AS (SELECT CAST(p AS BIGINT) AS pmid, min(cutoff) AS fallback FROM (SELECT unnest(pmids) AS p, cutoff FROM claim JOIN task USING (task)) GROUP BY 1), pool AS (SELECT pmid, year FROM corpus UNION ALL SELECT pmid, fallback FROM ct WHERE pmid NOT IN (SELECT pmid FROM corpus)) SELECT year, count(*) AS n, min(pmid) AS first FROM pool WHERE pmid NOT IN (SELECT pmid FROM gold) GROUP BY year",
    "l18_review_map": f"{D.with_sql('task')} SELECT task, review_pmid, review_pmid IS NULL AS fatal FROM task",
    "v02_nearest_cosine": f"{_VEC}, s AS (SELECT qid, id, round({_COS}, 6) AS score FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM s) SELECT qid, id, score FROM r WHERE rn <= 10",
    "v02_nearest_l2": f"{_VEC}, s AS (SELECT qid, id, round(list_distance(q.e, v.e), 6) AS distance FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rn FROM s) SELECT qid, id, distance FROM r WHERE rn <= 10",
    "v03_cutoff_views": f"{D.with_sql('corpus', 'task')} SELECT t.task, (SELECT count(*) FROM corpus c WHERE c.year > 0 AND c.year <= t.cutoff AND c.pmid IS DISTINCT FROM t.review_pmid) AS view_size FROM task t",
    "v04_filtered_nearest": f"{_VEC}, s AS (SELECT qid, id, round({_COS}, 6) AS score FROM q, v WHERE v.year <= 2012), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM s) SELECT qid, id, score FROM r WHERE rn <= 5",
    "v07_merge_metadata": f"{D.with_sql('corpus')}, x AS (SELECT doi, max(citation_count) AS ext_citations FROM papers_ext GROUP BY doi) SELECT count(*) AS n, count(ext_citations) AS hits, count(*) - count(ext_citations) AS misses FROM corpus LEFT JOIN x USING (doi) WHERE doi <> ''",
    "v09_candidate_pairs": f"{D.with_sql('vector')}, v AS (SELECT id, label, embedding::DOUBLE[] AS e FROM vector WHERE label IS NOT NULL), s AS (SELECT q.id AS qid, v.id, round({_COS}, 6) AS score FROM v q JOIN v ON v.label = q.label AND v.id <> q.id), r AS (SELECT * FROM s WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) <= 6) SELECT min(qid) AS a, least(qid, id) + greatest(qid, id) - min(qid) AS b, max(score) AS score FROM r GROUP BY least(qid, id), greatest(qid, id)",
    "g01_clean_edges": f"{_EDGES} SELECT *, n_raw - n_loops - n_edges AS n_repeats FROM (SELECT count(*) AS n_raw, count(*) FILTER (src = dst) AS n_loops, (SELECT count(*) FROM e) AS n_edges FROM edge)",
    "g02_adjacency": f"{_EDGES}, n AS (SELECT dst, src, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 50000 AS block, count(*) OVER (PARTITION BY dst) AS degree FROM e) SELECT dst, degree, list(src ORDER BY src) AS neighbours FROM n GROUP BY dst, block, degree",
    "g03_citation_counts": f"{_EDGES}, d AS (SELECT dst, count(*) AS deg FROM e GROUP BY dst) SELECT s_suppkey AS id, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END, deg, 0) AS n_citation FROM supplier LEFT JOIN d ON dst = s_suppkey",
    "g04_visible_neighbours": f"{_EDGES} SELECT p.p_partkey AS qid, p.p_partkey AS id, e.dst AS neighbour FROM part p JOIN e ON e.src = p.p_partkey JOIN part y ON y.p_partkey = e.dst WHERE y.p_partkey % 17 <> 0 AND 2000 + y.p_partkey % 26 <= 2005 + p.p_partkey % 20 AND e.dst <> p.p_partkey % 100",
    "g06_authority": f"{_EDGES} SELECT 1 AS qid, s_suppkey AS id, count(*) FILTER (src % 17 <> 0 AND 2000 + src % 26 <= 2014) AS citers, count(src) AS degree FROM supplier LEFT JOIN (SELECT e.* FROM e JOIN part ON p_partkey = src) ON dst = s_suppkey GROUP BY s_suppkey",
    "g08_paths": f"{D.with_sql('claim')}, e AS (SELECT pmids[1] AS src, pmids[2] AS dst, arg_max(tier, id) AS type FROM claim WHERE len(pmids) >= 2 AND pmids[1] <> pmids[2] GROUP BY 1, 2) SELECT CASE WHEN p.type = 'core' AND q.type = 'core' THEN 'chain' WHEN p.type = 'core' OR q.type = 'core' THEN 'mixed' ELSE 'other' END AS kind, count(*) AS n, count(DISTINCT p.src) AS starts FROM e p JOIN e q ON p.dst = q.src WHERE p.src <> q.dst GROUP BY 1",
    "g08_motifs": f"{D.with_sql('claim')}, l AS (SELECT task, generate_subscripts(restatements, 1) AS at_, unnest(restatements) AS r FROM units), e AS (SELECT l.task, r.source_id AS src, r.target_id AS dst, min(at_) AS at_, any_value(CASE tier WHEN 'core' THEN 'elaboration' WHEN 'support' THEN 'mechanism' ELSE 'evidence' END) AS type FROM l JOIN claim ON id = r.target_id WHERE r.source_id <> r.target_id GROUP BY 1, 2, 3), p AS (SELECT p.task, p.src AS a, p.dst AS b, q.dst AS c, p.type AS t1, q.type AS t2 FROM e p JOIN e q ON p.task = q.task AND p.dst = q.src WHERE p.src <> q.dst QUALIFY row_number() OVER (PARTITION BY p.task, p.src ORDER BY p.at_ DESC, q.at_ DESC) <= 50), k AS (SELECT DISTINCT task, CASE WHEN t1 = 'elaboration' AND t2 = 'elaboration' THEN 'chain' WHEN 'mechanism' IN (t1, t2) THEN 'mechanism_path' END AS kind, a, b, c FROM p) SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, kind ORDER BY a, b, c) <= 200",
    "g15_citation_weight": f"{D.with_sql('claim')}, p AS (SELECT task, unnest(list_distinct(pmids)) AS pmid FROM claim) SELECT task, pmid, count(*) AS weight FROM p GROUP BY ALL",
}
QUERIES = {n: globals()[n] for n in [*ORACLE, "l13_snippets"]}
