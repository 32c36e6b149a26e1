"""The domain relations, derived from the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import latest, table


#: Columns of the corpus and where they come from in the table.
_CORPUS = {
    "title": ("title", F.col), "abstract": ("abs", F.col), "year": ("date", lambda c: F.substring(c, 1, 4).try_cast("int")), "doi": ("doi", F.col),
    "n_citation": ("citation_count", F.col), "journal": ("journal", F.col), "authors": ("authors", F.col), "row": ("faiss_id", F.col),
}


def corpus(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """pmid, title, abstract, year (null if undated), doi, n_citation, journal, authors: one row per paper.

    With ``wanted`` pmid and those columns only, of which row is the key of the table's rows.  The latest row of a key is found by an aggregate of
    whole rows, so only columns that are named here stay out of the scan and of its shuffle.
    """
    names = wanted or tuple(c for c in _CORPUS if c != "row")
    p = table(spark, folder, "papers").select("faiss_id", "pmid", *[_CORPUS[c][0] for c in names if c != "row"], "loaded_at")
    return latest(p, ["faiss_id"]).select(F.col("pmid").cast("long").alias("pmid"), *[_CORPUS[c][1](_CORPUS[c][0]).alias(c) for c in names])


def _latest(spark: SparkSession, folder: str, name: str, keys: list[str], wanted: tuple[str, ...]) -> DataFrame:
    rows = table(spark, folder, name)
    return latest(rows.select(*keys, *wanted, "loaded_at") if wanted else rows, keys).drop("loaded_at")


def claims(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """The claims, one row per id; with ``wanted`` id, task and those columns only."""
    return _latest(spark, folder, "claims", ["id"], ("task", *wanted) if wanted else ())


def sections(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """The sections, one row per (task, id); with ``wanted`` the key and those columns only."""
    return _latest(spark, folder, "sections", ["task", "id"], wanted)


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """task, cutoff, review_pmid (the first hub), hubs, tail, n_claims."""
    return table(spark, folder, "units").select("task", "cutoff", F.get("hubs", F.lit(0)).cast("long").alias("review_pmid"), "hubs", "tail", "n_claims")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """qid, query, cutoff, review_pmid: each task asks with the titles of its first two root sections."""
    roots = sections(spark, folder, "title", "parent").where("parent is null or parent = ''").where("title is not null")
    text = roots.groupBy("task").agg(F.array_join(F.slice(F.array_sort(F.collect_set("title")), 1, 2), " ").alias("query"))
    return tasks(spark, folder).join(text, "task").select(F.col("task").alias("qid"), "query", "cutoff", "review_pmid")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst with repeats: who cites whom."""
    return table(spark, folder, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, embedding, label, year: the vectors with a year that is null for some."""
    year = F.when(F.col("vec_id") % 17 != 0, (2000 + F.col("vec_id") % 26).cast("int"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", year.alias("year"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """system, task, cluster, z: mean score of each system on each task."""
    o = table(spark, folder, "orders").groupBy("o_orderpriority", "o_custkey").agg((F.avg("o_totalprice") / 500000).alias("z"))
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderpriority").alias("system"), F.col("o_custkey").alias("task"), F.col("c_nationkey").alias("cluster"), "z")


def draws(spark: SparkSession, folder: str, *wanted: str) -> DataFrame:
    """The model calls, one row per draw_id; with ``wanted`` the key and those columns only."""
    return _latest(spark, folder, "draws", ["draw_id"], wanted)


#: The same relations as SQL, for the queries' own SQL.
SQL = {
    "corpus": "corpus AS (SELECT CAST(pmid AS BIGINT) AS pmid, title, abs AS abstract, TRY_CAST(substr(date, 1, 4) AS INT) AS year, doi, citation_count AS n_citation, journal, authors FROM papers QUALIFY row_number() OVER (PARTITION BY faiss_id ORDER BY loaded_at DESC) = 1)",
    "claim": "claim AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)",
    "section": "section AS (SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY task, id ORDER BY loaded_at DESC) = 1)",
    "task": "task AS (SELECT task, cutoff, CAST(hubs[1] AS BIGINT) AS review_pmid, hubs, tail, n_claims FROM units)",
    "query": "query AS (SELECT t.task AS qid, q.query, t.cutoff, t.review_pmid FROM task t JOIN (SELECT task, array_to_string(list_sort(list_distinct(list(title)))[1:2], ' ') AS query FROM section WHERE (parent IS NULL OR parent = '') AND title IS NOT NULL GROUP BY task) q USING (task))",
    "edge": "edge AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem)",
    "vector": "vector AS (SELECT vec_id AS id, embedding, label, CASE WHEN vec_id % 17 <> 0 THEN CAST(2000 + vec_id % 26 AS INT) END AS year FROM embeddings)",
    "score": "score AS (SELECT o_orderpriority AS system, o_custkey AS task, c_nationkey AS cluster, z FROM (SELECT o_orderpriority, o_custkey, avg(o_totalprice) / 500000 AS z FROM orders GROUP BY ALL) JOIN customer ON c_custkey = o_custkey)",
    "draw": "draw AS (SELECT * FROM draws QUALIFY row_number() OVER (PARTITION BY draw_id ORDER BY loaded_at DESC) = 1)",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named relations, to be followed by further ones or a SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
