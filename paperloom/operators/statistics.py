"""Calibration against human peers, paired contrasts and certified boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.student import t_quantile
from paperloom.operators.graph import rank_intervals

#: Quantiles of the peer band, least width of a style band, least tasks of a contrast.
LOW, HIGH, LEAST_WIDTH, LEAST_TASKS = 0.10, 0.90, 0.05, 10

C = F.col


def calibration(peers: DataFrame) -> DataFrame:
    """task, readout, own, q_lo, q_hi, median, n_peers, peer_sd of (task, readout, source, is_self, value).

    Null values do not count.  Without own value ``own`` is null, without peers the quantiles are, and
    with fewer than two ``peer_sd`` is.
    """
    other = F.when(~C("is_self"), C("value"))
    q = F.percentile(other, F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH)))
    out = peers.where("value is not null").groupBy("task", "readout").agg(
        F.max(F.when(C("is_self"), C("value"))).alias("own"), q.alias("_q"), F.count(other).alias("n_peers"), F.stddev_pop(other).alias("_sd")
    )
    return out.select("task", "readout", "own", C("_q")[0].alias("q_lo"), C("_q")[2].alias("q_hi"), C("_q")[1].alias("median"), "n_peers", F.when(C("n_peers") > 1, C("_sd")).alias("peer_sd"))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalise(values: DataFrame, band: DataFrame) -> DataFrame:
    """``values`` (task, readout, direction, family, value, ...) with z in 0..1 and z_note.

    Task readouts pass through.  A quality is placed between the low peer quantile and the review's
    own value; a style keeps 1 inside the peer band and falls off outside.  Without peers the own
    value alone decides; z is null where nothing can.
    """
    v, own, lo, hi = C("value"), C("own"), C("q_lo"), C("q_hi")
    quality = C("direction") == "quality"
    guard = quality & (own >= 0.999) & (lo >= 0.999)
    ceil = F.when(own.isNotNull() & (own > lo), own).otherwise(F.greatest(F.coalesce(own, F.lit(-1.0)), hi))
    width = F.greatest(hi - lo, F.lit(LEAST_WIDTH))
    off = F.when(v < lo, lo - v).when(v > hi, v - hi).otherwise(0.0)
    rules = [
        (v.isNull(), "bot", F.lit(None)),
        (C("family") == "task", "pass_through", v),
        (guard, "guardrail", _clamp(v)),
        (quality & lo.isNull() & (own.isNull() | (own <= 0)), "no_calibration", F.lit(None)),
        (quality & lo.isNull(), "no_peers", _clamp(v / own)),
        (quality & (ceil <= lo), "non_discriminating_task", F.lit(None)),
        (quality, "", _clamp((v - lo) / (ceil - lo))),
        ((lo.isNull() | hi.isNull()) & own.isNull(), "no_calibration", F.lit(None)),
        (lo.isNull() | hi.isNull(), "no_peers", F.greatest(F.lit(0.0), 1 - F.abs(v - own))),
    ]
    z, note = None, None
    for test, name, value in rules:
        test = F.coalesce(test, F.lit(False))
        z = F.when(test, value) if z is None else z.when(test, value)
        note = F.when(test, name) if note is None else note.when(test, name)
    joined = values.join(band, ["task", "readout"], "left")
    return joined.withColumns({"z": z.otherwise(1 - F.least(F.lit(1.0), off / width)).cast("double"), "z_note": note.otherwise("")})


def tolerances(peers: DataFrame) -> DataFrame:
    """readout, eps, n_pairs, admissible: the median gap between a review and its peers."""
    own = peers.where("is_self and value is not null").select("task", "readout", C("value").alias("own"))
    gaps = peers.where("not is_self and value is not null").join(own, ["task", "readout"]).select("readout", F.abs(C("value") - C("own")).alias("gap"))
    out = gaps.groupBy("readout").agg(F.percentile("gap", F.lit(0.5)).alias("eps"), F.count(F.lit(1)).alias("n_pairs"))
    return out.withColumn("admissible", (C("eps") > 0) & (C("eps") < 0.5))


def discriminability(peers: DataFrame) -> DataFrame:
    """readout, gap, peer_sd: median gap of reviews to their peers and mean spread among peers."""
    band = calibration(peers)
    gap = F.percentile(F.abs(C("own") - C("median")), F.lit(0.5))
    return band.groupBy("readout").agg(gap.alias("gap"), F.avg("peer_sd").alias("peer_sd"), F.count(F.lit(1)).alias("n"))


def t_table(df_: DataFrame, column: str, delta: float) -> DataFrame:
    """``df_`` with ``tq``: the two-sided t quantile at ``delta`` for ``column`` - 1 degrees of freedom.

    The quantile is computed once for each number of clusters that occurs; ``df_`` has one row per
    pair of systems, which are few.
    """
    met = [r[0] for r in df_.where(F.col(column) >= 2).select(column).distinct().collect()]
    rows = [(k, t_quantile(1 - delta / 2, k - 1)) for k in met]
    small = df_.sparkSession.createDataFrame(rows, f"{column} long, tq double")
    return df_.join(F.broadcast(small), column, "left")


def contrasts(scores: DataFrame, delta: float, eps: float = 0.0, least_tasks: int = LEAST_TASKS) -> DataFrame:
    """a, b, n, k, ours, opp, diff, se, q, certified, status for every pair of systems a < b.

    ``scores``: system, task, cluster, z.  Pairs are compared on the tasks both have; a null z is
    missing, never 0.  The standard error is robust to clusters of tasks, the radius q its t quantile
    at ``delta``.  Tasks are joined by key; only sums per (pair, cluster) are shuffled on.
    """
    s = scores.where("z is not null")
    left = s.select("task", "cluster", C("system").alias("a"), C("z").alias("za"))
    right = s.select("task", C("system").alias("b"), C("z").alias("zb"))
    per = left.join(right, "task").where("a < b").groupBy("a", "b", "cluster").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(C("za") - C("zb")).alias("_d"), F.sum("za").alias("_a"), F.sum("zb").alias("_b"), F.max(F.abs(C("za") - C("zb"))).alias("_m")
    )
    total = per.groupBy("a", "b").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("_d").alias("_td"), (F.sum("_a") / F.sum("_n")).alias("ours"), (F.sum("_b") / F.sum("_n")).alias("opp"), F.max("_m").alias("_m"))
    centred = per.join(total.select("a", "b", "n", "_td"), ["a", "b"]).groupBy("a", "b").agg(F.sum(F.pow(C("_d") - C("_n") * C("_td") / C("n"), F.lit(2.0))).alias("_ssq"))
    joined = t_table(total.join(centred, ["a", "b"]), "k", delta)
    few, lone = C("n") < least_tasks, C("k") < 2
    se = F.sqrt(C("k") / (C("k") - 1) * C("_ssq")) / C("n")
    diff, q = C("_td") / C("n"), C("tq") * se
    same = C("_m") == 0
    certified = ~few & ~lone & ~same & (F.abs(diff) > q + eps)
    status = F.when(few, "too_few_tasks").when(lone, "too_few_clusters").when(same, "tie_identical").when(certified, "decided").otherwise("undecided")
    hide = lambda c: F.when(~few & ~lone, c)
    return joined.select("a", "b", "n", "k", "ours", "opp", diff.alias("diff"), hide(se).alias("se"), hide(q).alias("q"), F.coalesce(certified, F.lit(False)).alias("certified"), status.alias("status"))


def leaderboard(scores: DataFrame, delta: float, eps: float = 0.0) -> DataFrame:
    """name, mean, best, worst: systems with the ranks that certified contrasts leave open.

    ``delta`` is divided by the number of all pairs.
    """
    names = scores.select(C("system").alias("name")).distinct()
    n = names.count()
    decided = contrasts(scores, delta / max(1, n * (n - 1) // 2), eps).where("certified")
    above = decided.select(F.when(C("diff") > 0, C("a")).otherwise(C("b")).alias("src"), F.when(C("diff") > 0, C("b")).otherwise(C("a")).alias("dst"))
    means = scores.groupBy(C("system").alias("name")).agg(F.avg("z").alias("mean"))
    return rank_intervals(names, above).join(means, "name")


def composite(axes: DataFrame) -> DataFrame:
    """system, task, composite, n_axes, agree: equal-axis mean of (system, task, axis, z).

    A task averages the axes it has; ``agree`` says whether all systems have the same axes on it.
    """
    per = axes.where("z is not null").groupBy("system", "task").agg(F.avg("z").alias("composite"), F.count(F.lit(1)).alias("n_axes"), F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("_set"))
    sets = per.groupBy("task").agg((F.countDistinct("_set") == 1).alias("agree"))
    return per.join(sets, "task").select("system", "task", "composite", "n_axes", "agree")


def sign_flip(diffs: DataFrame, by: list[str], replicates: int, seed: str = "flip") -> DataFrame:
    """``by``, statistic, exceed: |mean| of (``by``, cluster, d) and the share of sign flips that reach it.

    A cluster's sign in a replicate follows from a hash, so any partitioning gives the same draws.
    Sums per cluster are taken first; only they meet the replicates.
    """
    per = diffs.groupBy(*by, "cluster").agg(F.sum("d").alias("_s"), F.count(F.lit(1)).alias("_n"))
    sign = F.when(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "cluster")), 1, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    drawn = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    flipped = drawn.groupBy(*by, "rep").agg(F.abs(F.sum(C("_s") * sign) / F.sum("_n")).alias("m"))
    real = per.groupBy(*by).agg(F.abs(F.sum("_s") / F.sum("_n")).alias("statistic"))
    return flipped.join(real, by).groupBy(*by, "statistic").agg(F.avg((C("m") >= C("statistic") - 1e-12).cast("int")).alias("exceed"))
