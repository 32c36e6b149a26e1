"""Exact search over vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.ranking import top_k

#: A set of queries is broadcast in blocks of at most this many, so its size has a bound.
QUERY_BLOCK = 4096
#: Rows of a group are compared in squares of about this many by as many.
PAIR_BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """qid, id, score, rank: the ``k`` best of all vectors for each query, exactly.

    ``vectors`` has id, embedding; ``queries`` has qid, embedding.  Null and empty vectors have no
    neighbours; a query's own id may be among its results.  Queries go over all vectors in blocks of
    bounded size, by one matrix product per batch; each task hands on only its k best per query.
    """
    blocks = queries.where(F.size("embedding") > 0).select("qid", "embedding").orderBy("qid").toLocalIterator()
    out: DataFrame | None = None
    part: list = []
    for row in blocks:
        part.append(row)
        if len(part) == QUERY_BLOCK:
            scored = _block(vectors, part, k, metric, digits)
            out, part = (scored if out is None else out.unionByName(scored)), []
    if part or out is None:
        scored = _block(vectors, part, k, metric, digits)
        out = scored if out is None else out.unionByName(scored)
    return top_k(out, ["qid"], [F.col("score").desc(), F.col("id")], k)


def _block(vectors: DataFrame, queries: list, k: int, metric: str, digits: int) -> DataFrame:
    names = [r["qid"] for r in queries]
    wide = np.array([r["embedding"] for r in queries], dtype=np.float64) if queries else np.zeros((0, 1))
    unit = wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-12) if metric == "cosine" else wide
    shared = vectors.sparkSession.sparkContext.broadcast((names, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(names_)
        for batch in batches:
            if not batch.num_rows or not len(names_):
                continue
            x = _matrix(batch.column(1))
            if metric == "cosine":
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            s = q @ x.T if metric in ("cosine", "inner") else -np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T))
            s = np.round(s, digits)
            ids = batch.column(0).to_numpy()
            for i in range(len(names_)):
                score, who = np.concatenate([best[i][0], s[i]]), np.concatenate([best[i][1], ids])
                keep = np.lexsort((who, -score))[:k]
                best[i] = (score[keep], who[keep])
        for i, (score, who) in enumerate(best):
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array([names_[i]] * len(who), pa.int64()), pa.array(who, pa.int64()), pa.array(score, pa.float64())], names=["qid", "id", "score"])

    return vectors.where(F.size("embedding") > 0).select("id", "embedding").mapInArrow(run, "qid long, id long, score double")


def candidate_pairs(rows: DataFrame, group: str, part: str, k: int, least: float, digits: int = 6) -> DataFrame:
    """a, b, score: pairs that some row proposes, once each; a is the first by id that proposes.

    ``rows`` has id, embedding, ``group`` and ``part``.  Every row proposes the ``k`` rows of its
    group and of another part with the largest cosine, ``least`` or more, ties by larger id.  Null
    and empty vectors and rows without a group propose nothing; a null part is a part of its own.
    All pairs of a group are compared, in squares of blocks, so that no task holds a whole group.
    """
    own = rows.where((F.size("embedding") > 0) & F.col(group).isNotNull()).select("id", F.col(group).alias("g"), F.col(part).cast("string").alias("p"), "embedding")
    n = own.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("n"))
    dealt = own.join(n, "g").withColumn("at", F.pmod(F.xxhash64("id"), "n").cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    fields = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("g", "id", "p", "embedding")]
    x = dealt.select(*fields("x"), F.col("at").alias("xi"), others.alias("xj"))
    y = dealt.select(*fields("y"), others.alias("yi"), F.col("at").alias("yj"))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.stack(column.to_numpy()).astype(np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def square(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(a) and len(b):
            s = np.round(unit(a["x_embedding"]) @ unit(b["y_embedding"]).T, digits)
            to, parts = b["y_id"].to_numpy(), b["y_p"].to_numpy(object)
            for me, mine, row in zip(a["x_id"], a["x_p"], s):
                at = np.flatnonzero((row >= least) & (to != me))
                at = np.array([t for t in at if mine is None or parts[t] is None or parts[t] != mine], dtype=int)
                out += [(me, int(to[t]), float(row[t])) for t in at[np.lexsort((-to[at], -row[at]))[:k]]]
        return pd.DataFrame(out, columns=["a", "b", "score"])

    best = x.groupBy("x_g", "xi", "xj").cogroup(y.groupBy("y_g", "yi", "yj")).applyInPandas(square, "a long, b long, score double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), F.col("b").desc()))
    kept = best.withColumn("_r", rank).where(F.col("_r") <= k)
    pairs = kept.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"), F.max("score").alias("score"))
    return pairs.select("a", (F.col("lo") + F.col("hi") - F.col("a")).alias("b"), "score")
