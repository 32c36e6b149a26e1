"""An inverted index as tables, and searches over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import top_k
from paperloom.session import Workspace

#: The parameters of the ranking function and of the vocabulary.
K1, B, MAX_DF_FRACTION, MIN_DF = 0.9, 0.4, 0.30, 1


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key``, ``term``, ``tf``: a document's tokens are counted before the shuffle, as they lie together."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def vocabulary(counts: DataFrame, key: str, n_docs: int, max_fraction: float = MAX_DF_FRACTION, min_df: int = MIN_DF) -> DataFrame:
    """``term``, ``df``, ``idf`` of the terms that are neither too rare nor in too many documents.

    A fraction of 0, or of 1 and more, cuts nothing.
    """
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    if 0 < max_fraction < 1:
        df = df.where(F.col("df") <= int(max_fraction * n_docs))
    return df.withColumn("idf", F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def postings(counts: DataFrame, terms: DataFrame, key: str, mean_length: float, k1: float = K1, b: float = B) -> DataFrame:
    """``term``, ``key``, ``tf``, ``impact``: what a term adds to a document's score per query occurrence."""
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean_length)
    return counts.join(terms, "term").select("term", key, "tf", (F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("impact"))


def index(docs: DataFrame, key: str, tokens: Column, max_fraction: float = MAX_DF_FRACTION) -> DataFrame:
    """The postings of ``docs``; two small figures of the whole corpus go through the driver.

    Texts are tokenised once: the counts of each document, with its length, are written to the shared
    folder and serve the vocabulary and the postings.  Documents without tokens count for the mean
    length but have no postings; an empty corpus has none.
    """
    made = docs.select(key, tokens.alias("_tokens")).where(F.size("_tokens") > 0).select(key, F.size("_tokens").alias("dl"), F.explode("_tokens").alias("term"))
    counts = Workspace(docs.sparkSession, "index").write(made.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")))
    n, total = docs.select(key).count(), counts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    return postings(counts, vocabulary(counts, key, n, max_fraction), key, max(total / max(n, 1), 1e-9))


def visible(year: Column, cutoff: Column) -> Column:
    """Whether a paper may be looked up by id: dated, and no later than the cutoff."""
    return F.coalesce(year <= cutoff, F.lit(False))


def searchable(year: Column, cutoff: Column, year_min: Column | None = None, year_max: Column | None = None) -> Column:
    """Whether a search may return a paper: undated ones pass unless a first year is asked for.

    Without a cutoff only undated papers pass.
    """
    upper = cutoff if year_max is None else F.least(cutoff, year_max)
    dated = F.coalesce(year <= upper, F.lit(False))
    if year_min is None:
        return F.when(year.isNull(), True).otherwise(dated)
    return F.when(year.isNull(), year_min.isNull()).otherwise(dated & F.coalesce(year >= year_min, year_min.isNull()))


def search_scores(queries: DataFrame, query_tokens: Column, posts: DataFrame, years: DataFrame, key: str, exclude: str = "review_pmid", digits: int = 6) -> DataFrame:
    """qid, ``key``, score of all papers that share a term with the query and are searchable.

    Scores are rounded before they are ordered anywhere, so that ties do not hang on the order of
    summation.
    """
    asked = queries.select("qid", "cutoff", exclude, F.explode(query_tokens).alias("term")).groupBy("qid", "cutoff", exclude, "term").agg(F.count(F.lit(1)).alias("qtf"))
    scored = asked.join(posts, "term").groupBy("qid", "cutoff", exclude, key).agg(F.round(F.sum(F.col("qtf") * F.col("impact")), digits).alias("score"))
    dated = scored.join(years, key)
    return dated.where(searchable(F.col("year"), F.col("cutoff")) & ~F.col(key).eqNullSafe(F.col(exclude))).select("qid", key, "score")


def search(queries: DataFrame, query_tokens: Column, posts: DataFrame, years: DataFrame, key: str, k: int, exclude: str = "review_pmid") -> DataFrame:
    """qid, ``key``, score, rank, total: the best ``k`` papers of each query and how many there were."""
    scored = search_scores(queries, query_tokens, posts, years, key, exclude)
    # Counting scores, which are never null, makes the totals read the same shuffle as the ranking.
    totals = scored.groupBy("qid").agg(F.count("score").alias("total"))
    best = top_k(scored, ["qid"], [F.col("score").desc(), F.col(key)], k)
    return best.join(totals, "qid")


def allowlisted(scored: DataFrame, allow: DataFrame, key: str) -> DataFrame:
    """qid, ``key``, score, rank over each query's own list: what was found first, then the rest at score 0 by id."""
    return ranked_list(allow.join(scored, ["qid", key], "left"), key)


def ranked_list(scored: DataFrame, key: str) -> DataFrame:
    """qid, ``key``, score, rank of whole lists: the rows with a score, best first, then the rest at score 0 by id."""
    found = scored.select("qid", key, F.col("score").isNull().cast("int").alias("_part"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return top_k(found, ["qid"], [F.col("_part"), F.col("score").desc(), F.col(key)], 1 << 30).drop("_part")


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """The rows of one page and, as ``next``, where the next page begins (null on the last)."""
    rows = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    more = F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    return rows.withColumn("next", more)


def metered(hits: DataFrame, run: str, call: str, key: str, cap: int) -> DataFrame:
    """``hits`` (``run``, ``call``, ``key``, rank) that a run may still read: ``cap`` papers in all, in order of call and rank.

    A paper delivered before costs nothing.  Room never grows again, so a paper is delivered exactly
    if it is among the first ``cap`` that come up in its run.
    """
    first = hits.groupBy(run, key).agg(F.min(F.struct(call, "rank")).alias("_at"))
    allowed = top_k(first, [run], [F.col("_at")], cap).select(run, key)
    return hits.join(allowed, [run, key]).select(run, call, key, "rank")
