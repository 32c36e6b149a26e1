"""Search over packed blocks of documents: every query over every document, without a row per match.

Queries times documents is the number of matches, so none is ever a row: documents are packed by
blocks into postings, queries by chunks, and each task runs its chunks over its blocks and keeps the
best of each query.  Both are read from the shared folder; nothing is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import POOL_STOP
from paperloom.operators.lexical import K1, MAX_DF_FRACTION, B
from paperloom.session import Workspace

#: Documents of a block and queries of a chunk, which bound what a task holds.
BLOCK, CHUNK = 1 << 14, 4096
#: The year of documents that no search may return: those without a key.
NEVER = (1 << 31) - 1

_TOKEN = re.compile("[a-z0-9]{2,}")
_STOP = frozenset(POOL_STOP)


def _put(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each, after one that says how many."""
    kind = np.min_scalar_type(int(a.max())) if len(a) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def _get(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{data[0]}", offset=1).astype(np.int64)


_BLOCK = "block long, n int, total long, undated int, keys binary, refs binary, years binary, lengths binary, terms string, df binary, docs binary, tf binary"
_PARTS = ", part_of binary, part_sizes binary, part_terms binary"


def _packer(parts: bool):
    """Rows (key, ref, year, parts) to packed blocks."""

    def pack(block: int, keys: list, refs: list, years: list, texts: list) -> dict:
        year = np.array([NEVER if k is None else -NEVER if y is None else y for k, y in zip(keys, years)], dtype=np.int64)
        order = np.argsort(year, kind="stable")
        vocabulary: dict[str, int] = {}
        ids: list[int] = []
        per_part: list[int] = []
        part_of: list[int] = []
        at = 0
        for d in order.tolist():
            for text in texts[d] or ():
                found = [vocabulary.setdefault(t, len(vocabulary)) for t in _TOKEN.findall(text.lower()) if t not in _STOP] if text else []
                ids += found
                per_part.append(len(found))
                part_of.append(at)
            at += 1
        n, term = len(keys), np.array(ids, dtype=np.int64)
        part = np.repeat(np.arange(len(per_part)), per_part)
        of = np.array(part_of, dtype=np.int64)
        doc = of[part] if len(part) else part
        cell, tf = np.unique(term * n + doc, return_counts=True)
        out = {
            "block": block, "n": n, "total": len(term), "undated": int((year == -NEVER).sum()), "terms": " ".join(vocabulary),
            "keys": np.array([0 if keys[d] is None else keys[d] for d in order.tolist()], dtype=np.int64).tobytes(),
            "refs": np.array([refs[d] or 0 for d in order.tolist()], dtype=np.int64).tobytes(), "years": year[order].tobytes(),
            "lengths": _put(np.bincount(doc, minlength=n)), "df": _put(np.bincount(cell // n, minlength=len(vocabulary))), "docs": _put(cell % n), "tf": _put(tf),
        }
        if parts:
            # The distinct terms of each part, part by part.
            pairs = np.unique(part * max(len(vocabulary), 1) + term)
            out |= {"part_of": _put(of), "part_sizes": _put(np.bincount(pairs // max(len(vocabulary), 1), minlength=len(of))), "part_terms": _put(pairs % max(len(vocabulary), 1))}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list[list] = [[], [], [], []]
        for batch in batches:
            for have, column in zip(held, batch.columns):
                have += column.to_pylist()
            while len(held[0]) >= BLOCK:
                yield pa.RecordBatch.from_pylist([pack(number, *[h[:BLOCK] for h in held])], schema=_schema(parts))
                held, number = [h[BLOCK:] for h in held], number + 1
        if held[0]:
            yield pa.RecordBatch.from_pylist([pack(number, *held)], schema=_schema(parts))

    return run


def _schema(parts: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in (_BLOCK + (_PARTS if parts else "")).split(", ")])


class Packed(NamedTuple):
    """Packed documents: their blocks, the documents' number and mean length, and the number of blocks."""

    blocks: DataFrame
    n: int
    mean: float
    number: int


def pack(docs: DataFrame, key: str, year: str, parts: Column, ref: str | None = None, keep_parts: bool = False) -> Packed:
    """``docs`` (one row per ``key``) by blocks; ``parts`` is the array of a document's texts.

    Tokens are those of ``functions.text.pool_tokens``.  ``ref`` is a number that hits bring along.
    Documents without key or tokens count for the mean length.  Three figures go through the driver.
    """
    rows = docs.select(F.col(key).cast("long"), (F.col(ref).cast("long") if ref else F.lit(None).cast("long")).alias("ref"), F.col(year).cast("int").alias("year"), parts.alias("parts"))
    blocks = Workspace(docs.sparkSession, "blocks").write(rows.mapInArrow(_packer(keep_parts), _BLOCK + (_PARTS if keep_parts else "")))
    n, total, number = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count(F.lit(1))).first()
    return Packed(blocks, n, max(total / max(n, 1), 1e-9), number)


def _frequencies(packed: Packed) -> DataFrame:
    """term, df over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
                if terms:
                    yield pa.RecordBatch.from_arrays([pa.array(terms.split(" ")), pa.array(_get(df))], names=["term", "df"])

    return packed.blocks.select("terms", "df").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _chunks(packed: Packed, queries: DataFrame, query_tokens: Column, exclude: str, max_fraction: float, extra: str | None) -> tuple[DataFrame, int, int]:
    """One row per chunk of queries with their weighted terms; the number of chunks, and of parts of the blocks."""
    spark = queries.sparkSession
    carried = [extra] if extra else []
    asked = Workspace(spark, "asked").write(queries.select("qid", F.col("cutoff").cast("int").alias("cutoff"), F.col(exclude).cast("long").alias("exclude"), query_tokens.alias("tokens"), *carried))
    terms = asked.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    df = F.col("df")
    known = terms.select("term").distinct().join(_frequencies(packed), "term")
    if 0 < max_fraction < 1:
        known = known.where(df <= int(max_fraction * packed.n))
    known = known.withColumn("idf", F.log1p((F.lit(packed.n) - df + 0.5) / (df + 0.5)))
    weighted = terms.join(known, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "qtf", "idf")).alias("weights"))
    whole = asked.join(weighted, "qid", "left")
    total, cores = asked.count(), spark.sparkContext.defaultParallelism
    number = max(1, min(total, max(2 * cores, -(-total // CHUNK))))
    groups = 1 if number >= cores else min(max(packed.number, 1), -(-2 * cores // number))
    # Queries of equal words lie together, by the hundred, and are scored once.
    words = F.array_join(F.array_sort("tokens"), " ")
    nth = F.floor((F.row_number().over(Window.partitionBy(words).orderBy("qid")) - 1) / 256)
    chunk = whole.withColumn("nth", nth).withColumn("chunk", F.pmod(F.xxhash64(words, "nth"), F.lit(number)).cast("int")).groupBy("chunk").agg(F.collect_list(F.struct("qid", "cutoff", "exclude", "tokens", "weights", *carried)).alias("asked"))
    return chunk.repartitionById(number, F.col("chunk")), number, groups


class _Block:
    """A block unpacked: postings with what each adds to a score per unit of idf."""

    def __init__(self, row: dict, mean: float) -> None:
        self.block, self.n, self.undated = row["block"], row["n"], row["undated"]
        self.keys, self.refs, self.years = (np.frombuffer(row[c], dtype=np.int64) for c in ("keys", "refs", "years"))
        self.terms = {t: i for i, t in enumerate(row["terms"].split(" "))} if row["terms"] else {}
        self.ends = np.cumsum(_get(row["df"]))
        self.docs, tf = _get(row["docs"]), _get(row["tf"])
        norm = tf + K1 * (1 - B + B * _get(row["lengths"])[self.docs] / mean)
        self.gain = tf * (K1 + 1) / norm
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted_keys = self.keys[self.order]

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Where the keys stand in the block, -1 if they don't; documents without a key are never meant."""
        if not len(wanted) or not self.n:
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.sorted_keys, wanted), self.n - 1)
        place = np.where(self.sorted_keys[at] == wanted, self.order[at], -1)
        return np.where(self.years[place] == NEVER, -1, place)


class _Chunk:
    """A chunk of queries with numbered terms."""

    def __init__(self, asked: list[dict]) -> None:
        self.asked, self.terms = asked, {}
        self.idf: list[float] = []
        self.weights: list[list[tuple[int, int]]] = []
        for q in asked:
            mine = []
            for w in sorted(q["weights"] or (), key=lambda w: w["term"]):
                i = self.terms.setdefault(w["term"], len(self.terms))
                if i == len(self.idf):
                    self.idf.append(w["idf"])
                mine.append((i, w["qtf"]))
            self.weights.append(mine)
        self.order = sorted(range(len(asked)), key=self.weights.__getitem__)
        self.cutoffs = np.array([-NEVER if q["cutoff"] is None else q["cutoff"] for q in asked], dtype=np.int64)
        self.excluded = np.array([q["exclude"] if q["exclude"] is not None else 0 for q in asked], dtype=np.int64)
        self.excludes = np.array([q["exclude"] is not None for q in asked], dtype=bool)

    def scores(self, block: _Block) -> Iterator[tuple[int, int, np.ndarray | None]]:
        """(query, how many of the block's documents it may see, their scores or None if nothing matches)."""
        held: list = []
        for t, i in self.terms.items():
            at = block.terms.get(t)
            if at is None:
                held.append(None)
            else:
                s = slice(int(block.ends[at - 1]) if at else 0, int(block.ends[at]))
                held.append((block.docs[s], block.gain[s] * self.idf[i]))
        seen = np.searchsorted(block.years, self.cutoffs, side="right").tolist()
        out = np.where(self.excludes, block.places(self.excluded), -1).tolist()
        last, whole = None, None
        for i in self.order:
            weights, stop, left_out = self.weights[i], seen[i], out[i]
            if weights != last and stop:
                last, met = weights, [(held[t], n) for t, n in weights if held[t] is not None]
                docs, gains = [d for (d, _), _ in met], [g if n == 1 else g * n for (_, g), n in met]
                whole = np.bincount(np.concatenate(docs), np.concatenate(gains), minlength=block.n) if met else None
            score = whole[:stop] if stop and whole is not None else None
            if score is not None and 0 <= left_out < stop:
                score = score.copy()
                score[left_out] = 0
            yield i, stop, score


def _pairs(packed: Packed, chunks: DataFrame, groups: int, columns: list[str]) -> DataFrame:
    """Every block with every chunk: the chunks of a task are held, its blocks are read one after the other."""
    return packed.blocks.select(*columns).coalesce(groups).crossJoin(chunks.hint("shuffle_replicate_nl"))


def _rows(batches: Iterator[pa.RecordBatch], chunk_of: dict) -> Iterator[tuple[dict, int]]:
    """The rows of a task as (block's columns, chunk); each chunk is read once into ``chunk_of``."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            chunk = row.pop("chunk").as_py()
            if chunk not in chunk_of:
                chunk_of[chunk] = _Chunk(row["asked"].as_py())
            yield {c: v.as_py() for c, v in row.items() if c != "asked"}, chunk


_SEARCHED = ["block", "n", "undated", "keys", "refs", "years", "lengths", "terms", "df", "docs", "tf"]


def best(packed: Packed, queries: DataFrame, query_tokens: Column, key: str, k: int, exclude: str = "review_pmid", max_fraction: float = MAX_DF_FRACTION, digits: int = 6) -> DataFrame:
    """qid, total, hits (score, ``key``, ref, block, place) of each query that finds something: its best ``k``, in order.

    ``queries`` has qid (once each), cutoff and ``exclude``.  Scores are rounded before they are
    compared, ties are ordered by ``key``; totals count all that may be returned.
    """
    chunks, _, groups = _chunks(packed, queries, query_tokens, exclude, max_fraction, None)
    mean = packed.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: dict[int, _Chunk] = {}
        state: dict[int, tuple[list, list, list]] = {}
        last = None
        for row, number in _rows(batches, chunk_of):
            if last is None or last.block != row["block"]:
                last = _Block(row, mean)
            chunk = chunk_of[number]
            if number not in state:
                state[number] = [None] * len(chunk.asked), [0] * len(chunk.asked), [0.0] * len(chunk.asked)
            kept, totals, least = state[number]
            for i, _, score in chunk.scores(last):
                if score is None:
                    continue
                totals[i] += np.count_nonzero(score)
                near = np.flatnonzero(score >= least[i] - 10.0**-digits if least[i] else score > 0)
                if len(near) > k:  # at least k rounded scores reach this one, so those below it need no sorting
                    near = near[score[near] >= np.partition(score[near], len(near) - k)[len(near) - k] - 10.0**-digits]
                if not len(near):
                    continue
                new = np.round(score[near], digits), last.keys[near], last.refs[near], np.full(len(near), last.block), near
                if kept[i] is not None:
                    new = tuple(np.concatenate(c) for c in zip(kept[i], new))
                order = np.lexsort((new[1], -new[0]))[:k]
                kept[i] = tuple(c[order] for c in new)
                if len(order) == k:
                    least[i] = float(kept[i][0][-1])
        for number, (kept, totals, _) in state.items():
            found = [i for i, h in enumerate(kept) if h is not None]
            for lo in range(0, len(found), 500):
                some = found[lo : lo + 500]
                columns = [np.concatenate([kept[i][c] for i in some]) for c in range(5)]
                hits = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["score", key, "ref", "block", "place"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(kept[i][0]) for i in some]]), pa.int32()), hits)
                yield pa.RecordBatch.from_arrays([pa.array([chunk_of[number].asked[i]["qid"] for i in some], pa.string()), pa.array([int(totals[i]) for i in some], pa.int64()), lists], names=["qid", "total", "hits"])

    parts = _pairs(packed, chunks, groups, _SEARCHED).mapInArrow(run, f"qid string, total long, hits array<struct<score: double, {key}: long, ref: long, block: long, place: long>>")
    if groups == 1:
        return parts
    merged = F.array_sort(F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct((-h["score"]).alias("_s"), h[key].alias("_k"), h.alias("h"))))))
    return parts.groupBy("qid").agg(F.sum("total").alias("total"), F.transform(F.slice(merged, 1, k), lambda x: x["h"]).alias("hits"))


def search(packed: Packed, queries: DataFrame, query_tokens: Column, key: str, k: int, *carried: str, **options) -> DataFrame:
    """qid, ``key``, score, rank, total, with ``carried`` of ref, block, place: as ``lexical.search``."""
    found = best(packed, queries, query_tokens, key, k, **options)
    return found.select("qid", "total", F.posexplode("hits").alias("rank", "h")).select("qid", f"h.{key}", "h.score", (F.col("rank") + 1).alias("rank"), "total", *[f"h.{c}" for c in carried])


def listed_scores(packed: Packed, queries: DataFrame, query_tokens: Column, listed: str, key: str, exclude: str = "review_pmid", max_fraction: float = MAX_DF_FRACTION, digits: int = 6) -> DataFrame:
    """qid, ``key``, score of the searchable documents of each query's own list ``listed``; null without a shared term."""
    chunks, _, groups = _chunks(packed, queries, query_tokens, exclude, max_fraction, listed)
    mean = packed.mean

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: dict[int, _Chunk] = {}
        wanted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        last = None
        for row, number in _rows(batches, chunk_of):
            if last is None or last.block != row["block"]:
                last = _Block(row, mean)
            chunk = chunk_of[number]
            if number not in wanted:
                lists = [np.unique(np.array([p for p in q[listed] or () if p is not None], dtype=np.int64)) for q in chunk.asked]
                wanted[number] = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            keys, of = wanted[number]
            place = last.places(keys)
            here = np.flatnonzero((place >= 0) & ~(chunk.excludes[of] & (keys == chunk.excluded[of])))
            start = np.searchsorted(of[here], np.arange(len(chunk.asked) + 1)).tolist()
            out: tuple[list, list, list] = ([], [], [])
            for i, stop, score in chunk.scores(last):
                for j in here[start[i] : start[i + 1]].tolist():
                    if place[j] < stop:
                        value = 0.0 if score is None else float(score[place[j]])
                        for column, x in zip(out, (chunk.asked[i]["qid"], int(keys[j]), round(value, digits) if value else None)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["qid", key, "score"])

    return _pairs(packed, chunks, groups, _SEARCHED).mapInArrow(run, f"qid string, {key} long, score double")


def best_parts(packed: Packed, queries: DataFrame, query_tokens: Column, key: str, k: int, exclude: str = "review_pmid") -> DataFrame:
    """qid, ``key``, k, overlap: of each of the best ``k`` documents the part, after the first, with most of the query's tokens.

    The earliest of equals; documents of one part have no row.  ``packed`` must keep its parts.
    """
    hits = best(packed, queries, query_tokens, key, k, exclude).withColumnRenamed("qid", "_q").select("_q", F.transform("hits", lambda h: F.struct(h[key].alias("key"), h["block"].alias("block"), h["place"].alias("place"))).alias("hits"))
    asked = queries.join(hits, F.col("qid") == F.col("_q")).drop("_q")
    chunks, _, groups = _chunks(packed, asked, query_tokens, exclude, 0.0, "hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_of: dict[int, _Chunk] = {}
        hits_of: dict[int, tuple] = {}
        for row, number in _rows(batches, chunk_of):
            chunk = chunk_of[number]
            if number not in hits_of:
                number_of: dict[str, int] = {}
                mine = [{number_of.setdefault(t, len(number_of)) for t in q["tokens"]} for q in chunk.asked]
                flat = [(h["block"], h["place"], i, h["key"]) for i, q in enumerate(chunk.asked) for h in q["hits"]]
                table = np.array(flat, dtype=np.int64).reshape(-1, 4)
                has = np.zeros((len(mine), len(number_of) + 1), dtype=bool)
                for i, m in enumerate(mine):
                    has[i, list(m)] = True
                for q in chunk.asked:
                    q["hits"] = None
                hits_of[number] = number_of, has, table[np.argsort(table[:, 0], kind="stable")]
            number_of, has, table = hits_of[number]
            lo, hi = np.searchsorted(table[:, 0], [row["block"], row["block"] + 1])
            if lo == hi or not row["terms"]:
                continue
            local = np.array([number_of.get(t, len(number_of)) for t in row["terms"].split(" ")], dtype=np.int64)
            of, sizes, terms = _get(row["part_of"]), _get(row["part_sizes"]), local[_get(row["part_terms"])]
            begin = np.searchsorted(of, np.arange(row["n"] + 1))
            ends = np.cumsum(sizes)
            for at in range(lo, hi, 20_000):
                place, query, key_of = table[at : min(at + 20_000, hi), 1:].T
                # One element per hit and part after the first, then one per term of it.
                n_parts = np.maximum(begin[place + 1] - begin[place] - 1, 0)
                hit = np.repeat(np.arange(len(place)), n_parts)
                nth = np.arange(len(hit)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
                part = begin[place[hit]] + 1 + nth
                size = sizes[part]
                cell = np.repeat(np.arange(len(part)), size)
                term = terms[np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[part] - size, size)]
                overlap = np.bincount(cell[has[query[hit[cell]], term]], minlength=len(part))
                order = np.lexsort((nth, -overlap, hit))
                first = order[np.flatnonzero(np.r_[True, hit[order][1:] != hit[order][:-1]])] if len(order) else order
                names = [chunk.asked[i]["qid"] for i in query[hit[first]].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(key_of[hit[first]]), pa.array(nth[first].astype(np.int32)), pa.array(overlap[first].astype(np.int32))], names=["qid", key, "k", "overlap"])

    return _pairs(packed, chunks, groups, ["block", "n", "terms", "part_of", "part_sizes", "part_terms"]).mapInArrow(run, f"qid string, {key} long, k int, overlap int")
