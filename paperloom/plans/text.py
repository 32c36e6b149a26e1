"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.ranking import fit_to_budget
from paperloom.sources import domain as D
from paperloom.sources.tables import latest, table

C = F.col


def _docs(spark, folder):
    return latest(table(spark, folder, "documents").select("doc_id", "text", "loaded_at"), ["doc_id"]).drop("loaded_at")


_DOC = "doc AS (SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"


def t01_pool_tokens(spark, f):
    return D.corpus(spark, f, "title", "abstract").select("pmid", T.pool_tokens(F.concat_ws(" ", "title", "abstract")).alias("tokens"))


def t02_query_tokens(spark, f):
    return D.corpus(spark, f, "title").select("pmid", T.query_tokens(C("title")).alias("tokens"))


def _raw_ids(spark, f):
    raw = F.when(C("pmid") % 5 == 0, F.concat(F.lit("PMID: "), "pmid")).when(C("pmid") % 5 == 1, F.concat(F.lit(" pubmed:"), "pmid")).when(C("pmid") % 5 == 2, C("pmid").cast("string"))
    raw = raw.when(C("pmid") % 5 == 3, F.concat(F.lit("CorpusId:"), "pmid", F.lit("x"))).otherwise(F.concat(F.lit("doi:"), "pmid"))
    return D.corpus(spark, f, "doi").select("pmid", raw.alias("raw"))


def t04_resolve_id(spark, f):
    return _raw_ids(spark, f).select("pmid", T.resolve_id(C("raw")).alias("resolved"))


def t05_year_range(spark, f):
    y = C("year").cast("string")
    raw = F.when(C("pmid") % 5 == 0, y).when(C("pmid") % 5 == 1, F.concat(y, F.lit("-"))).when(C("pmid") % 5 == 2, F.concat(F.lit("-"), y)).when(C("pmid") % 5 == 3, F.concat(y, F.lit(" - "), (C("year") + 3).cast("string"))).otherwise("n.d.")
    low, high = T.year_range(C("raw"))
    return D.corpus(spark, f, "year").select("pmid", raw.alias("raw")).select("pmid", low.alias("year_min"), high.alias("year_max"))


def t06_clean_text(spark, f):
    return _docs(spark, f).where("text is not null").select("doc_id", T.digest(T.clean_text(C("text"))).alias("digest"))


def t08_sentences(spark, f):
    return D.claims(spark, f, "text").select("id", F.posexplode(T.sentences(C("text"))).alias("k", "sentence"))


def t09_locators(spark, f):
    title = F.array(F.coalesce("title", F.lit("")))
    body = F.coalesce(T.loose_sentences(C("abstract")), F.array().cast("array<string>"))
    return D.corpus(spark, f, "title", "abstract").select("pmid", F.posexplode(F.concat(title, body)).alias("k", "sentence")).select(F.format_string("pmid%d_%d", "pmid", "k").alias("locator"), "pmid", F.length("sentence").alias("n_chars"))


def t10_citation_markers(spark, f):
    return D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", T.citation_markers(C("abstract")).alias("markers"))


def t11_reference_ids(spark, f):
    return D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", T.reference_ids(C("abstract")).alias("ids"))


def t12_section_kind(spark, f):
    return D.sections(spark, f, "title").where("title is not null").groupBy(T.section_kind(C("title")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def t13_noise(spark, f):
    s = D.corpus(spark, f, "abstract").select("pmid", F.explode(T.loose_sentences(C("abstract"))).alias("s"))
    return s.groupBy("pmid").agg(F.count_if(T.is_noise(C("s"))).alias("noise"), F.count(F.lit(1)).alias("n"))


def t14_heading(spark, f):
    return table(spark, f, "outline_nodes").where("title is not null").select(T.heading(C("title")).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


def t15_word_counts(spark, f):
    return _docs(spark, f).where("text is not null").select("doc_id", T.word_count(C("text")).cast("long").alias("words"), T.blank_count(C("text")).cast("long").alias("tokens"))


def t18_bins(spark, f):
    d = D.draws(spark, f, "n_prompt_tokens", "n_completion_tokens")
    return d.groupBy(T.resource_bin(C("n_prompt_tokens")).alias("bin"), T.result_effect(C("n_completion_tokens"), C("n_prompt_tokens")).alias("effect")).agg(F.count(F.lit(1)).alias("n"))


def t20_digests(spark, f):
    return D.claims(spark, f, "text").where("text is not null").select("id", T.digest(C("text")).alias("sha256"), F.left(T.digest(C("text")), F.lit(16)).alias("sha16"), F.md5("text").alias("md5"), F.concat(F.lit("sha256:"), T.digest(C("text"))).alias("labelled"))


def t21_seal(spark, f):
    body = F.concat(F.lit('{"cutoff": '), F.coalesce(C("cutoff").cast("string"), F.lit("null")), F.lit(', "hubs": ['), F.array_join(F.transform("hubs", lambda h: F.concat(F.lit('"'), h, F.lit('"'))), ", "), F.lit('], "task": "'), "task", F.lit('"}'))
    return D.tasks(spark, f).where("hubs is not null").select("task", T.digest(body).alias("content_hash"))


def t24_fit_to_context(spark, f):
    c = D.claims(spark, f, "text").where("text is not null and text <> ''").select("task", "id", "text")
    return fit_to_budget(c, ["task"], ["id"], F.length("text"), 2000).select("task", "id", "upto")


def t25_snippet(spark, f):
    return D.corpus(spark, f, "abstract").where("abstract is not null").select("pmid", T.snippet(C("abstract")).alias("snippet"))


def t26_bibtex(spark, f):
    return D.corpus(spark, f, "title", "year", "journal").select("pmid", T.bibtex(C("pmid"), C("title"), C("journal"), C("year")).alias("entry"))


def t27_synthetic_ids(spark, f):
    return D.corpus(spark, f, "year").select("pmid", T.synthetic_id(C("year"), C("pmid")).alias("synthetic_id"), F.when(C("year").isNotNull(), F.format_string("%04d-06-30", "year")).alias("synthetic_date"), T.strip_scheme(T.synthetic_id(C("year"), C("pmid"))).alias("stripped"))


def t28_encoder_text(spark, f):
    both = F.when(C("title").isNull() | (C("title") == ""), C("abstract")).when(C("abstract").isNull() | (C("abstract") == ""), C("title")).otherwise(F.concat("title", F.lit(". "), "abstract"))
    return D.corpus(spark, f, "title", "abstract").select("pmid", T.digest(F.concat(F.lit("search_document: "), both)).alias("digest"))


def t29_paragraphs(spark, f):
    d = _docs(spark, f).where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("k", "paragraph")).where(C("paragraph").rlike(r"[^\s]"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.max(F.length("paragraph")).cast("long").alias("longest"))


_ALL = lambda col, p: f"regexp_extract_all({col}, '{p}')"
_STOP = ", ".join(f"'{w}'" for w in T.POOL_STOP)
_QSTOP = ", ".join(f"'{w}'" for w in T.QUERY_STOP)
_RAW_YEAR = "CASE pmid % 5 WHEN 0 THEN CAST(year AS VARCHAR) WHEN 1 THEN CAST(year AS VARCHAR) || '-' WHEN 2 THEN '-' || CAST(year AS VARCHAR) WHEN 3 THEN CAST(year AS VARCHAR) || ' - ' || CAST(year + 3 AS VARCHAR) ELSE 'n.d.' END"
_LOOSE = r"list_filter(string_split(regexp_replace(abstract, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"
_BR, _PAREN = T.CITED[0], T.CITED[3]

ORACLE = {
    "t01_pool_tokens": f"{D.with_sql('corpus')} SELECT pmid, list_filter(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS tokens FROM corpus",
    "t02_query_tokens": f"{D.with_sql('corpus')} SELECT pmid, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_QSTOP}) AND NOT regexp_full_match(t, '(19|20)[0-9][0-9]')))) AS tokens FROM corpus",
    "t04_resolve_id": f"{D.with_sql('corpus')} SELECT pmid, CASE WHEN pmid % 5 IN (0, 1, 2) THEN CAST(pmid AS VARCHAR) END AS resolved FROM corpus",
    "t05_year_range": f"{D.with_sql('corpus')}, r AS (SELECT pmid, year, {_RAW_YEAR} AS raw FROM corpus) SELECT pmid, CASE WHEN pmid % 5 IN (0, 1, 3) THEN year END AS year_min, CASE pmid % 5 WHEN 0 THEN year WHEN 2 THEN year WHEN 3 THEN year + 3 END AS year_max FROM r",
    "t06_clean_text": rf"WITH {_DOC} SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f]+', '', 'g'), '-[ \t\n\r\f\v]+', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS digest FROM doc WHERE text IS NOT NULL",
    "t08_sentences": rf"{D.with_sql('claim')}, s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM claim) SELECT id, unnest(range(len(s)))::INT AS k, unnest(s) AS sentence FROM s",
    "t09_locators": rf"{D.with_sql('corpus')}, s AS (SELECT pmid, list_concat([coalesce(title, '')], coalesce({_LOOSE}, [])) AS s FROM corpus), u AS (SELECT pmid, unnest(range(len(s))) AS k, unnest(s) AS sentence FROM s) SELECT 'pmid' || pmid || '_' || k AS locator, pmid, length(sentence) AS n_chars FROM u",
    "t10_citation_markers": f"{D.with_sql('corpus')} SELECT pmid, list_concat({', '.join(_ALL('abstract', p) for p in T.CITED)}) AS markers FROM corpus WHERE abstract IS NOT NULL",
    "t11_reference_ids": rf"{D.with_sql('corpus')}, m AS (SELECT pmid, unnest(list_concat({_ALL('abstract', _BR)}, {_ALL('abstract', _PAREN)})) AS m FROM corpus WHERE abstract IS NOT NULL), p AS (SELECT pmid, unnest(regexp_split_to_array(regexp_replace(m, '[\[\]()\s]', '', 'g'), '[,;]')) AS p FROM m), b AS (SELECT pmid, regexp_split_to_array(p, '[–—-]') AS b FROM p), n AS (SELECT pmid, TRY_CAST(b[1] AS INT) AS lo, TRY_CAST(b[2] AS INT) AS hi, len(b) AS k FROM b), i AS (SELECT pmid, unnest(CASE WHEN k = 1 AND lo IS NOT NULL THEN [lo] WHEN k = 2 AND hi > lo AND hi - lo <= 50 THEN range(lo, hi + 1) ELSE [] END)::INT AS i FROM n) SELECT c.pmid, coalesce(list_sort(list_distinct(list(i) FILTER (i IS NOT NULL))), []) AS ids FROM corpus c LEFT JOIN i USING (pmid) WHERE abstract IS NOT NULL GROUP BY c.pmid",
    "t12_section_kind": f"{D.with_sql('section')} SELECT CASE WHEN lower(title) LIKE 'abstract%' THEN 'abstract' WHEN lower(title) LIKE 'keywords%' THEN 'keywords' WHEN lower(title) LIKE 'references%' THEN 'references' WHEN lower(title) LIKE '%introduction%' THEN 'background' WHEN lower(title) LIKE '%conclusion%' OR lower(title) LIKE '%discussion%' THEN 'discussion_or_conclusion' ELSE 'body' END AS kind, count(*) AS n FROM section WHERE title IS NOT NULL GROUP BY 1",
    "t13_noise": rf"{D.with_sql('corpus')}, s AS (SELECT pmid, unnest({_LOOSE}) AS s FROM corpus) SELECT pmid, count(*) FILTER (regexp_matches(s, '(?i)\bdoi:') OR len(regexp_extract_all(s, '[A-Z][a-z]{{2,}}[0-9]+')) >= 2) AS noise, count(*) AS n FROM s GROUP BY pmid",
    "t14_heading": r"SELECT regexp_replace(regexp_replace(regexp_replace(lower(title), '^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+', ''), '\s+', ' ', 'g'), '^[ :.\-]+|[ :.\-]+$', '', 'g') AS heading, count(*) AS n FROM outline_nodes WHERE title IS NOT NULL GROUP BY 1",
    "t15_word_counts": rf"WITH {_DOC} SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS words, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS tokens FROM doc WHERE text IS NOT NULL",
    "t18_bins": f"{D.with_sql('draw')}, x AS (SELECT coalesce(n_prompt_tokens, 0) AS n, coalesce(n_completion_tokens, 0) AS m, greatest(n_prompt_tokens, 1) AS k FROM draw) SELECT CASE WHEN n <= 0 THEN '0' WHEN n <= 16 THEN '1-16' WHEN n <= 64 THEN '17-64' WHEN n <= 256 THEN '65-256' WHEN n <= 1024 THEN '257-1024' ELSE '>1024' END AS bin, CASE WHEN m = 0 THEN 'none' WHEN m <= 0.2 * k THEN 'few' WHEN m <= 0.8 * k THEN 'some' ELSE 'many' END AS effect, count(*) AS n FROM x GROUP BY 1, 2",
    "t20_digests": f"{D.with_sql('claim')} SELECT id, sha256(text) AS sha256, left(sha256(text), 16) AS sha16, md5(text) AS md5, 'sha256:' || sha256(text) AS labelled FROM claim WHERE text IS NOT NULL",
    "t21_seal": f"""{D.with_sql('task')} SELECT task, sha256('{{"cutoff": ' || coalesce(CAST(cutoff AS VARCHAR), 'null') || ', "hubs": [' || coalesce(array_to_string(list_transform(hubs, lambda h: '"' || h || '"'), ', '), '') || '], "task": "' || task || '"}}') AS content_hash FROM task WHERE hubs IS NOT NULL""",
    "t24_fit_to_context": f"{D.with_sql('claim')}, r AS (SELECT task, id, sum(length(text)) OVER (PARTITION BY task ORDER BY id) AS upto, row_number() OVER (PARTITION BY task ORDER BY id) AS rn FROM claim WHERE text <> '') SELECT task, id, upto FROM r WHERE rn = 1 OR upto <= 2000",
    "t25_snippet": rf"{D.with_sql('corpus')} SELECT pmid, CASE WHEN length(abstract) <= 320 THEN abstract ELSE regexp_replace(substr(abstract, 1, 320), '\s[^\s]*$', '') || ' ...' END AS snippet FROM corpus WHERE abstract IS NOT NULL",
    "t26_bibtex": f"{D.with_sql('corpus')} SELECT pmid, '@article{{pmid' || pmid || ', title={{' || coalesce(title, '') || '}}, journal={{' || coalesce(journal, '') || '}}, year={{' || coalesce(CAST(year AS VARCHAR), '') || '}}}}' AS entry FROM corpus",
    "t27_synthetic_ids": f"{D.with_sql('corpus')} SELECT pmid, CASE WHEN year IS NOT NULL THEN printf('%04d07.%d', year, pmid) END AS synthetic_id, CASE WHEN year IS NOT NULL THEN printf('%04d-06-30', year) END AS synthetic_date, CASE WHEN year IS NOT NULL THEN CAST(pmid AS VARCHAR) END AS stripped FROM corpus",
    "t28_encoder_text": f"{D.with_sql('corpus')} SELECT pmid, sha256('search_document: ' || CASE WHEN title IS NULL OR title = '' THEN abstract WHEN abstract IS NULL OR abstract = '' THEN title ELSE title || '. ' || abstract END) AS digest FROM corpus",
    "t29_paragraphs": rf"WITH {_DOC}, p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS p FROM doc WHERE text IS NOT NULL) SELECT doc_id, count(*) AS paragraphs, max(length(p)) AS longest FROM p WHERE regexp_matches(p, '[^\s]') GROUP BY doc_id",
}
QUERIES = {n: globals()[n] for n in ORACLE}
