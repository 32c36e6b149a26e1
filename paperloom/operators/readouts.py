"""Unit scores of a system's evidence, claims and outline against a task's graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def ratio(part: Column, whole: Column) -> Column:
    """``part`` by ``whole``; null, never 0, if there is nothing to divide by."""
    return part / F.nullif(whole, F.lit(0))


def citation_weights(claims: DataFrame) -> DataFrame:
    """task, pmid, weight: number of claims of the task that cite the paper."""
    return claims.select("task", F.explode(F.array_distinct("pmids")).alias("pmid")).groupBy("task", "pmid").agg(F.count(F.lit(1)).alias("weight"))


def weighted_recall(members: DataFrame, given: DataFrame) -> DataFrame:
    """task, stratum, recall, n: weight of the members that were given by the weight of all.

    ``members``: task, stratum, pmid, weight; ``given``: task, pmid.  Repeats of a given paper count once.
    """
    hit = given.select("task", "pmid").distinct().withColumn("_hit", F.lit(1))
    joined = members.join(hit, ["task", "pmid"], "left")
    found = F.sum(F.when(C("_hit").isNotNull(), C("weight")).otherwise(0))
    return joined.groupBy("task", "stratum").agg(ratio(found, F.sum("weight")).alias("recall"), F.count(F.lit(1)).alias("n"))


def strata(weights: DataFrame, quantile: float) -> DataFrame:
    """``weights`` with stratum hub or tail: hubs reach the quantile of their task and exceed its median."""
    cut = weights.groupBy("task").agg(F.percentile("weight", F.lit(quantile)).alias("_q"), F.percentile("weight", F.lit(0.5)).alias("_m"))
    hub = (C("weight") >= C("_q")) & (C("weight") > C("_m"))
    return weights.join(cut, "task").select("task", "pmid", "weight", F.when(hub, "hub").otherwise("tail").alias("stratum"))


def claim_tiers(claims: DataFrame, contradicted: float = 0.5, entailed: float = 0.5, quantile: float = 0.75) -> DataFrame:
    """id, task, tier: unscorable without a grounding, forbidden if contradicted and not entailed,
    required if entailed and of great weight in its task, else admissible."""
    cut = claims.groupBy("task").agg(F.percentile("weight", F.lit(quantile)).alias("_q"))
    yes = C("groundedness") >= entailed
    tier = F.when(C("groundedness").isNull() & C("contradict").isNull(), "unscorable").when((C("contradict") >= contradicted) & ~F.coalesce(yes, F.lit(False)), "forbidden")
    tier = tier.when(yes & (C("weight") >= C("_q")), "required").otherwise("admissible")
    return claims.join(cut, "task").select("id", "task", tier.alias("tier"))


def set_overlap(sets: DataFrame, key: str, member: str) -> DataFrame:
    """a, b, common, jaccard of all keys a < b that share a member: (``key``, ``member``) rows, distinct.

    Only sharing pairs are formed, from sizes that were aggregated before.
    """
    sizes = sets.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    left, right = sets.select(C(key).alias("a"), member), sets.select(C(key).alias("b"), member)
    shared = left.join(right, member).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    one, two = sizes.select(C(key).alias("a"), C("n").alias("na")), sizes.select(C(key).alias("b"), C("n").alias("nb"))
    return shared.join(one, "a").join(two, "b").select("a", "b", "common", (C("common") / (C("na") + C("nb") - C("common"))).alias("jaccard"))


def profile(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``by``, ``value``, share: how the rows of each group spread over the values."""
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("all_"))
    return counts.join(totals, by).select(by, value, (C("n") / C("all_")).alias("share"))


def pair_agreement(placed: DataFrame) -> DataFrame:
    """task, tp, fp, fn, tn, rand, ari over pairs of papers placed by both sides.

    ``placed``: task, pmid, human, system, one section each.  Pairs are counted from the sizes of the
    sections and of their intersections; no pair is formed.
    """
    choose = lambda c: C(c) * (C(c) - 1) / 2
    cells = placed.groupBy("task", "human", "system").agg(F.count(F.lit(1)).alias("n"))
    both = cells.groupBy("task").agg(F.sum(choose("n")).alias("both"))
    human = cells.groupBy("task", "human").agg(F.sum("n").alias("n")).groupBy("task").agg(F.sum(choose("n")).alias("h"))
    system = cells.groupBy("task", "system").agg(F.sum("n").alias("n")).groupBy("task").agg(F.sum(choose("n")).alias("s"))
    whole = cells.groupBy("task").agg(F.sum("n").alias("n")).select("task", choose("n").alias("pairs"))
    j = both.join(human, "task").join(system, "task").join(whole, "task")
    tp, fp, fn = C("both"), C("s") - C("both"), C("h") - C("both")
    tn = C("pairs") - C("both") - fp - fn
    exp, top = C("s") * C("h") / F.nullif("pairs", F.lit(0)), (C("s") + C("h")) / 2
    return j.select("task", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), tn.cast("long").alias("tn"), ratio(tp + tn, C("pairs")).alias("rand"), F.when(top != exp, (tp - exp) / (top - exp)).alias("ari"))
