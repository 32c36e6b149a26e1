"""Joins that resolve, check and match records by rules."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.assignment import one_to_one
from paperloom.session import Workspace

C = F.col


def fold_doi(text: Column) -> Column:
    """An identifier without address, label and case; null if there is none."""
    t = F.regexp_replace(F.lower(F.trim(text)), "%2f", "/")
    return F.nullif(F.regexp_extract(t, r"(10\.\d{4,9}/[^\s]+?)[.,;]*$", 1), F.lit(""))


def fold_title(text: Column) -> Column:
    """Letters a-z and digits of a title in lower case; null if none are left."""
    return F.nullif(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), F.lit(""))


def unique_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``value`` of the keys that name exactly one value."""
    g = df.where(C(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    return g.where(C(value) == C("_hi")).select(key, value)


def cascade(rows: DataFrame, id_: str, steps: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``rows`` with ``id_`` and ``matched_by``: the first step whose key names one record.

    A step is (name, key column of ``rows``, table of (key column, ``id_``) with unique keys).
    """
    out = rows
    for name, key, known in steps:
        out = out.join(known.withColumnRenamed(id_, f"_{name}"), key, "left")
    found = [C(f"_{name}") for name, _, _ in steps]
    why = reduce(lambda acc, s: acc.when(C(f"_{s[0]}").isNotNull(), s[0]), steps[1:], F.when(found[0].isNotNull(), steps[0][0]))
    return out.withColumns({id_: F.coalesce(*found), "matched_by": why.otherwise("none")}).drop(*[f"_{n}" for n, _, _ in steps])


def near_repeats(df: DataFrame, by: str, order: str, tokens: str, norm: str, least: float = 0.8) -> DataFrame:
    """``by``, ``order``, earlier, similarity, kind: for each query the earliest earlier one it repeats.

    An equal normal form is "exact"; else a Jaccard similarity of the token sets of ``least`` or more
    is "near".  Candidates share one of the rarest tokens that any pair so similar must share, so
    no pairs are formed within a group but such.  Queries without tokens repeat only exactly.
    """
    rows = df.select(by, order, tokens, norm)
    first = rows.groupBy(by, norm).agg(F.min(order).alias("_first"))
    exact = rows.join(first, [by, norm]).where(C("_first") < C(order)).select(by, order, C("_first").alias("earlier"), F.lit(1.0).alias("similarity"), F.lit("exact").alias("kind"))
    each = rows.select(by, order, tokens, F.explode(tokens).alias("t"))
    freq = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    n = F.size(tokens)
    rank = F.row_number().over(Window.partitionBy(by, order).orderBy("df", "t"))
    prefix = each.join(freq, "t").withColumn("_r", rank).where(C("_r") <= n - F.ceil(n * least) + 1)
    a = prefix.select(by, "t", C(order).alias("i"), C(tokens).alias("ta"))
    b = prefix.select(by, "t", C(order).alias("j"), C(tokens).alias("tb"))
    pairs = a.join(b, [by, "t"]).where((C("j") < C("i")) & (F.size("tb") >= F.size("ta") * least) & (F.size("ta") >= F.size("tb") * least)).dropDuplicates([by, "i", "j"])
    sim = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    near = pairs.withColumn("s", sim).where(C("s") >= least).groupBy(by, C("i").alias(order)).agg(F.min("j").alias("earlier"), F.min_by("s", "j").alias("similarity"))
    rest = near.join(exact.select(by, order), [by, order], "left_anti").withColumn("kind", F.lit("near"))
    return exact.unionByName(rest.select(by, order, "earlier", "similarity", "kind"))


def containment(df: DataFrame, id_: str, by: str, tokens: str, least: float = 0.5) -> DataFrame:
    """``id_``, partner, containment, links: for each record the one whose tokens hold most of its own, or the reverse.

    The containment of two token sets is what they share by the size of the smaller.  Records of one
    group of ``by`` are compared; of equal partners that of smallest ``id_`` is taken, and ``links`` counts
    all that reach ``least``.  What the smaller set shares includes one of its rarest tokens, as many
    as it may leave unshared and one more, so only these are looked up among the tokens of the others.
    Null groups and empty sets have no partners.  ``tokens`` holds distinct tokens.
    """
    rows = df.where(C(by).isNotNull() & (F.size(tokens) > 0)).select(C(id_).alias("i"), C(by).alias("g"), C(tokens).alias("w"))
    each = rows.select("i", "g", F.size("w").alias("n"), F.explode("w").alias("t"))
    freq = each.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("i").orderBy("df", "t"))
    small = each.join(freq, "t").withColumn("_r", rarest).where(C("_r") <= C("n") - F.ceil(C("n") * least) + 1).select(C("i").alias("x"), "g", "t", C("n").alias("nx"))
    large = each.select(C("i").alias("y"), "g", "t", C("n").alias("ny"))
    found = small.join(large, ["g", "t"]).where((C("x") != C("y")) & ((C("ny") > C("nx")) | ((C("ny") == C("nx")) & (C("x") < C("y"))))).select("x", "y").distinct()
    both = found.join(rows.select(C("i").alias("x"), C("w").alias("wx")), "x").join(rows.select(C("i").alias("y"), C("w").alias("wy")), "y")
    near = both.select("x", "y", (F.size(F.array_intersect("wx", "wy")) / F.size("wx")).alias("c")).where(C("c") >= least)
    ends = near.select(C("x").alias(id_), C("y").alias("p"), "c").unionByName(near.select(C("y").alias(id_), C("x").alias("p"), "c"))
    best = ends.groupBy(id_).agg(F.min_by("p", F.struct((-C("c")).alias("d"), C("p"))).alias("partner"), F.max("c").alias("containment"), F.count(F.lit(1)).alias("links"))
    return best


def missing(rows: DataFrame, key: str, known: DataFrame, rule: str) -> DataFrame:
    """rule, n: how many distinct keys of ``rows`` are not among ``known`` (same column name)."""
    return rows.where(C(key).isNotNull()).select(key).distinct().join(known.select(key), key, "left_anti").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))


def repeated(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """rule, n: how many keys occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


# ---------------------------------------------------------------------------------------------
# Headings


def token_set_ratio(a: str, b: str) -> float:
    """0..100: how alike two headings are, whatever the order and repetition of their words.

    The common words are compared with each side's common and own words; the best of the three
    similarities counts.  A similarity is twice the longest common subsequence by both lengths.
    """

    def ratio(x: str, y: str) -> float:
        if not x and not y:
            return 100.0
        # Bit i of rest is 0 where the subsequence grows at character i of x.
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        rest = full = (1 << len(x)) - 1
        for c in y:
            u = rest & at.get(c, 0)
            rest = (rest + u | rest - u) & full
        return 200.0 * (len(x) - rest.bit_count()) / (len(x) + len(y))

    p, q = set(a.lower().split()), set(b.lower().split())
    if not p or not q:
        return 0.0
    common = " ".join(sorted(p & q))
    left, right = (" ".join(x for x in (common, " ".join(sorted(s))) if x) for s in (p - q, q - p))
    if common and (not p - q or not q - p):
        return 100.0
    return max(ratio(left, right), ratio(common, left) if common else 0.0, ratio(common, right) if common else 0.0)


def match_headings(ours: DataFrame, theirs: DataFrame, by: str, least: float = 80.0, per: tuple[str, ...] = ()) -> DataFrame:
    """``per``, ``by``, ours, theirs, score: headings matched one to one within a group, best score first.

    ``per`` are further columns of ``ours``, such as the system: each of its groups is matched with
    all of ``theirs``.  Ties go to the larger titles.  Headings meet that have a word in common; without
    one the score is a ratio of whole texts, which only texts near in length can reach, so all such
    lengths meet.  Null and empty headings match nothing.
    """
    kind = ours.schema[by].dataType.simpleString()
    longer = (200.0 - least) / least

    def keyed(side: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                keys = []
                for title in pdf[side]:
                    words = sorted(set(title.lower().split()))
                    n = len(" ".join(words))
                    lengths = range(math.ceil(n / longer - 1e-9), math.floor(n * longer + 1e-9) + 1) if side == "ours" else [n]
                    keys.append(["w" + w for w in words] + [f"n{k}" for k in lengths if words])
                yield pdf.assign(key=keys).explode("key").dropna(subset="key")

        return run

    own = ours.where("title <> ''").select(*per, by, C("title").alias("ours")).distinct()
    a = own.select(by, "ours").distinct().mapInPandas(keyed("ours"), f"{by} {kind}, ours string, key string")
    b = theirs.where("title <> ''").select(by, C("title").alias("theirs")).distinct().mapInPandas(keyed("theirs"), f"{by} {kind}, theirs string, key string")
    pairs = a.join(b, [by, "key"]).select(by, "ours", "theirs").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["score"] = [token_set_ratio(x, y) for x, y in zip(pdf["ours"], pdf["theirs"])]
            yield pdf[pdf["score"] >= least]

    scored = pairs.mapInPandas(score, f"{by} {kind}, ours string, theirs string, score double")
    edges = own.join(scored, [by, "ours"]).select(*per, by, "ours", "theirs", "score")
    return one_to_one(edges, [*per, by], "ours", "theirs", [("score", True), ("ours", True), ("theirs", True)], Workspace(ours.sparkSession, "headings"))
