"""What a run drafted, read back from its model calls: roles by signature, drafts by target, owners of revisions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters at the head of a draft that a revising prompt must hold, and the length of the pieces compared first.
HEAD, PIECE = 200, 32


def role_of(prompt: Column, signatures: list[tuple[str, str]], rule: str = "first") -> Column:
    """The role of a call by the signatures (name, pattern) that its prompt shows.

    ``first``: the first that matches, else "other".  ``only``: the one that matches, "unmatched" if none
    does and "ambiguous" if several do.  A null prompt matches none.
    """
    hits = F.filter(F.array(*[F.when(prompt.rlike(p), n) for n, p in signatures]), lambda x: x.isNotNull())
    if rule == "first":
        return F.coalesce(F.get(hits, F.lit(0)), F.lit("other"))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size(hits) == 0, "unmatched").otherwise("ambiguous")


def role_by_ends(prompt: Column, ends: list[tuple[str, str, str]]) -> Column:
    """The first role (name, head, tail) whose head opens the prompt and whose tail closes it; "other" if none."""
    return reduce(lambda acc, e: acc.when(prompt.rlike("^(?:" + e[1] + ")") & prompt.rlike("(?:" + e[2] + r")\s*$"), e[0]), ends, F.when(prompt.isNull(), "other")).otherwise("other")


def usable(completion: Column, error: Column) -> Column:
    """Whether a call gave something: text that is not blank, and no error."""
    return F.coalesce(completion.rlike(r"\S"), F.lit(False)) & error.isNull()


def drafts(calls: DataFrame, keys: list[str], order: list[str], pick: str = "last") -> DataFrame:
    """The ``last`` or ``first`` of the calls of each of ``keys`` in ``order``, with ``calls``: how many there were.

    Rows with a null in ``keys`` form a group of their own; ``order`` must end in a key.
    """
    rank = F.struct(*order)
    rest = [c for c in calls.columns if c not in keys]
    chosen = (F.max_by if pick == "last" else F.min_by)(F.struct(*rest), rank)
    return calls.groupBy(*keys).agg(chosen.alias("_row"), F.count(F.lit(1)).alias("calls")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], "calls")


def outline_tree(outlines: DataFrame, key: str, lines: str, level: Column, title: Column) -> DataFrame:
    """``key``, k, level, title, parent, leaf: the nodes of outlines given as arrays of lines.

    ``level`` (1 to 6, null for a line that is no node) and ``title`` are expressions over the column line.
    The parent is the nearest node before of a lower level; a node is a leaf if none has it as parent.
    """
    rows = outlines.select(key, F.posexplode(lines).alias("k", "line")).select(key, "k", level.alias("level"), title.alias("title")).where("level is not null")
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.greatest(*[F.when(F.col("level") > lv, F.max(F.when(F.col("level") == lv, F.col("k"))).over(before)) for lv in range(1, 6)])
    after = F.lead("level").over(Window.partitionBy(key).orderBy("k"))
    return rows.select(key, "k", "level", "title", parent.alias("parent"), (F.coalesce(after, F.lit(0)) <= F.col("level")).alias("leaf"))


def _pieces(text: str) -> np.ndarray:
    """Hashes of all pieces of a text, in order."""
    return np.array([xxhash.xxh3_64_intdigest(text[i : i + PIECE]) >> 1 for i in range(len(text) - PIECE + 1)], dtype=np.int64)


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def owners(texts: DataFrame, prompts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, id, prompt_id: the drafts whose first HEAD characters stand in a prompt of the same group.

    ``texts`` has ``by``, id, text and ``prompts`` has ``by``, prompt_id, prompt; blanks are squeezed on both
    sides.  Each draft's head puts up its piece of least hash; a prompt puts up that of every stretch of
    HEAD characters.  A stretch that equals the head has the same, so no pair is lost, and pairs that
    share one are checked on their characters.  Shorter drafts, null texts and null groups own nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.schema.fields, *prompts.schema.fields]}

    def put_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, least = [], []
            for i, t in enumerate(batch.column("_t").to_pylist()):
                h = _pieces(t)
                width = HEAD - PIECE + 1
                if len(h) >= width:
                    found = np.unique(np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1))
                    at += [i] * len(found)
                    least += found.tolist()
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in batch.schema.names), pa.array(least, pa.int64())], names=[*batch.schema.names, "_h"])

    def side(df: DataFrame, id_: str, text: Column) -> DataFrame:
        schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, id_]) + ", _t string, _h long"
        return df.select(*by, id_, text.alias("_t")).where("_t is not null").mapInArrow(put_up, schema)

    heads = side(texts, "id", F.when(F.length(_squeezed(F.col("text"))) >= HEAD, F.substring(_squeezed(F.col("text")), 1, HEAD))).withColumnRenamed("_t", "_head")
    both = heads.join(side(prompts, "prompt_id", _squeezed(F.col("prompt"))), [*by, "_h"])
    return both.where(F.contains("_t", "_head")).select(*by, "id", "prompt_id").distinct()


def nearest_unused(calls: DataFrame, log: DataFrame, keys: list[str], window_s: float) -> DataFrame:
    """call, line: calls matched one to one to the log lines of equal ``keys``, in the order of time.

    ``calls`` has ``keys``, call, t and ``log`` has ``keys``, line, t.  The k-th call of a key takes its k-th
    line, if they are no more than ``window_s`` seconds apart; calls without a line have a null one.
    """
    number = lambda df, i: df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("t", i)))
    c, r = number(calls, "call"), number(log, "line").withColumnRenamed("t", "_t")
    gap = F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    return c.join(r, [*keys, "_k"], "left").select(*keys, "call", F.when(gap <= window_s * 1e6, F.col("line")).alias("line"))


def references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, n, k, body, calls: the numbered lines under a heading of references, up to the next heading.

    Of lines with one number the first holds, and ``calls`` says how many there were.  Lines are numbered
    as "1. ...", "1) ..." or "[1] ..."; k is the line's place.  Null texts have none.
    """
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("k", "line"))
    head = F.col("line").rlike("^#{1,6} ")
    titled = F.col("line").rlike(r"(?i)^#{1,6} +(\d+[.)]? +)?(references|bibliography):?\s*$")
    upto = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("under", F.max(F.when(head, F.struct("k", titled.alias("refs")))).over(upto)["refs"]).where("under").where(~head)
    part = lambda i: F.regexp_extract("line", r"^\s*\[?(\d+)[\].)]\s+(.*)$", i)
    return drafts(rows.select(key, part(1).try_cast("int").alias("n"), "k", part(2).alias("body")).where("n is not null"), [key, "n"], ["k"], "first")
