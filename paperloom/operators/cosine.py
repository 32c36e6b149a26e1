"""Cosines of texts as vectors of their token counts, exactly.

Vectors of an encoder, where there are some, are searched by ``operators.vectors``; here a text is its
own vector, one dimension per token, so that every figure can be checked in SQL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import POOL_STOP

_TOKEN, _STOP = re.compile("[a-z0-9]{2,}"), frozenset(POOL_STOP)
#: Texts of a group that are compared as one block; a larger group is dealt over several tasks.
BLOCK = 1 << 14


def term_counts(texts: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """``keys``, term, tf of each text; texts without tokens have no rows."""
    return texts.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def cosine_cells(a: DataFrame, b: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """``by``, a, b, cosine: the cells of the cosine matrix of two sets of texts that are not 0.

    ``a`` has ``by``, a, tokens and ``b`` has ``by``, b, tokens, each text once.  Texts are compared within
    a group of ``by``; null groups, ids and texts have no cells.  Partial sums run before the shuffle.
    """
    ta, tb = term_counts(a, [*by, "a"], "tokens"), term_counts(b, [*by, "b"], "tokens")
    norm = lambda t, k: t.groupBy(*by, k).agg(F.sum(F.col("tf") * F.col("tf")).alias(f"_{k}"))
    dots = ta.withColumnRenamed("tf", "x").join(tb.withColumnRenamed("tf", "y"), [*by, "term"]).groupBy(*by, "a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("_dot"))
    cells = dots.join(norm(ta, "a"), [*by, "a"]).join(norm(tb, "b"), [*by, "b"])
    return cells.select(*by, "a", "b", F.round(F.col("_dot") / F.sqrt(F.col("_a").cast("double") * F.col("_b")), digits).alias("cosine"))


def _cosine(digits: int):
    """Adds the cosine of the token lists x and y of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = Counter(x), Counter(y)
                dot = sum(n * q[t] for t, n in p.items() if t in q)
                out.append(round(dot / sqrt(sum(n * n for n in p.values()) * sum(n * n for n in q.values())), digits))
            kept = [c for c in batch.schema.names if c not in ("x", "y")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], names=[*kept, "cosine"])

    return run


def cosine_join(a: DataFrame, b: DataFrame, by: list[str], least: float, digits: int = 6) -> DataFrame:
    """``by``, a, b, cosine: pairs of texts of a group with a cosine of ``least`` or more, all of them.

    Terms are put in one order, rarest first.  What a text has after the point where the rest of its
    vector is shorter than ``least`` of the whole can't make a pair alone, so the two texts of a pair
    share a term before that point, and only those terms, which are the rare ones, are joined.
    Candidates are then compared on all their tokens.
    """
    ta, tb = term_counts(a, [*by, "a"], "tokens"), term_counts(b, [*by, "b"], "tokens")
    freq = ta.select("term").union(tb.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def first_terms(t: DataFrame, k: str) -> DataFrame:
        order = Window.partitionBy(*by, k).orderBy("df", "term")
        square = F.col("tf") * F.col("tf")
        rest = F.sum(square).over(order.rowsBetween(0, Window.unboundedFollowing))
        whole = F.sum(square).over(Window.partitionBy(*by, k))
        return t.join(freq, "term").select(*by, k, "term", rest.alias("_rest"), whole.alias("_whole")).where(F.col("_rest") >= (least * least - 1e-9) * F.col("_whole")).select(*by, k, "term")

    found = first_terms(ta, "a").join(first_terms(tb, "b"), [*by, "term"]).select(*by, "a", "b").distinct()
    both = found.join(a.select(*by, "a", F.col("tokens").alias("x")), [*by, "a"]).join(b.select(*by, "b", F.col("tokens").alias("y")), [*by, "b"])
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "a", "b"]) + ", cosine double"
    return both.select(*by, "a", "b", "x", "y").mapInArrow(_cosine(digits), schema).where(F.col("cosine") >= least)


class _Said:
    """The sentences of a block, each text once under its smallest id, with postings of their tokens."""

    def __init__(self, first: dict[str, str]) -> None:
        self.first, self.ids, self.vocabulary = first, list(first.values()), {}
        ids: list[int] = []
        lengths = []
        for text in first:
            found = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in _TOKEN.findall(text) if t not in _STOP]
            ids += found
            lengths.append(len(found))
        n = max(len(first), 1)
        cell, tf = np.unique(np.array(ids, dtype=np.int64) * n + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        self.docs, self.tf = cell % n, tf.astype(np.float64)
        self.ends = np.cumsum(np.bincount(cell // n, minlength=len(self.vocabulary))).tolist()
        self.square = np.maximum(np.bincount(self.docs, self.tf * self.tf, minlength=n), 1)

    def near(self, text: str, least: float, digits: int) -> tuple[float, str] | None:
        """The greatest cosine of ``least`` or more and the smallest id that has it."""
        counts = Counter(t for t in _TOKEN.findall(text) if t not in _STOP)
        docs, dots = [], []
        for t, n in counts.items():
            at = self.vocabulary.get(t)
            if at is not None:
                part = slice(self.ends[at - 1] if at else 0, self.ends[at])
                docs.append(self.docs[part])
                dots.append(self.tf[part] * n if n > 1 else self.tf[part])
        if not docs:
            return None
        dot, square = np.bincount(np.concatenate(docs), np.concatenate(dots)), sum(n * n for n in counts.values())
        high = np.flatnonzero(dot * dot >= (least - 10.0**-digits) ** 2 * square * self.square[: len(dot)])
        found = [(-c, self.ids[i]) for i in high.tolist() if (c := round(float(dot[i]) / sqrt(square * float(self.square[i])), digits)) >= least]
        return (-(best := min(found))[0], best[1]) if found else None


def sayings(texts: DataFrame, group: str, sizes: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """``group``, id, sentence, cosine, kind: for each asking text the sentence of its group that says it.

    ``texts`` has ``group``, id, said (whether it is a sentence), norm: in lower case, none null.  An equal text is
    ``exact``; else that of the greatest cosine of ``least`` or more is ``near``, then of the smallest
    id.  Each text moves once, except that the askers of a group above BLOCK texts meet each of its
    blocks.  ``sizes`` (``group``, n) bounds the groups from above; those of more than BLOCK texts are
    broadcast, at most one for each BLOCK texts.
    """
    large = sizes.where(F.col("n") > BLOCK).select(group, F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"))
    dealt = texts.join(F.broadcast(large), group, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("norm"), F.col("_n")).cast("int"))
    placed = dealt.select(group, F.explode(F.when(F.col("said"), own).otherwise(F.sequence(F.lit(0), F.col("_n") - 1))).alias("block"), (~F.col("said")).alias("asks"), "id", "norm")
    keyed = placed.repartition(group, "block").sortWithinPartitions(group, "block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, said = None, {}, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for g, block, asks, key, norm in zip(*[c.to_pylist() for c in batch.columns]):
                if (g, block) != at:
                    at, first, said = (g, block), {}, None
                if not asks:
                    first[norm] = min(key, first.get(norm, key))
                    continue
                if said is None:
                    said = _Said(first)
                found = (1.0, first[norm]) if norm in first else said.near(norm, least, digits)
                if found:
                    for column, x in zip(out, (g, key, found[1], found[0], "exact" if norm in first else "near")):
                        column.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[group, "id", "sentence", "cosine", "kind"])

    found = keyed.mapInArrow(run, f"{group} string, id string, sentence string, cosine double, kind string")
    order = F.struct("kind", (-F.col("cosine")).alias("c"), "sentence")
    best = found.groupBy(group, "id").agg(F.min_by(F.struct("sentence", "cosine", "kind"), order).alias("_b"))
    return best.select(group, "id", "_b.sentence", "_b.cosine", "_b.kind")


def best_cosines(texts: DataFrame, key: str, group: str, sets: dict, digits: int = 6) -> DataFrame:
    """``key``, ``group``, best: the greatest cosine of each text to the texts of its group's set; 0 if none is near.

    ``sets`` maps a group to a list of token lists and is broadcast, so it must be bounded: the caller
    says by what.  ``texts`` has ``key``, ``group``, tokens and does not move.  Groups without a set
    have no rows.
    """
    shared = texts.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}

        def postings(g) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], int]:
            if g not in index:
                lists: dict[str, list] = {}
                for i, tokens in enumerate(shared.value[g]):
                    counts = Counter(tokens)
                    norm = sqrt(sum(n * n for n in counts.values()))
                    for t, n in counts.items():
                        lists.setdefault(t, []).append((i, n / norm))
                index[g] = {t: (np.array([i for i, _ in v]), np.array([w for _, w in v])) for t, v in lists.items()}, len(shared.value[g])
            return index[g]

        for batch in batches:
            out = []
            for g, tokens in zip(batch.column(group).to_pylist(), batch.column("tokens").to_pylist()):
                if g not in shared.value:
                    out.append(None)
                    continue
                lists, n = postings(g)
                counts = Counter(tokens or [])
                total = np.zeros(max(n, 1))
                for t, k in counts.items():
                    if t in lists:
                        at, w = lists[t]
                        total[at] += k * w
                norm = sqrt(sum(k * k for k in counts.values())) or 1.0
                out.append(round(float(total.max()) / norm, digits))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(group), pa.array(out, pa.float64())], names=[key, group, "best"])

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    return texts.select(key, group, "tokens").mapInArrow(run, f"{key} {kinds[key]}, {group} {kinds[group]}, best double").where("best is not null")
