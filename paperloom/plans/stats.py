"""Queries of calibration, contrasts and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.student import t_quantile
from paperloom.operators import statistics as S
from paperloom.operators.graph import closure, tierable
from paperloom.sources import domain as D
from paperloom.sources.tables import table

C = F.col
DELTA = 0.05


def _r(c, digits=6):
    return F.round(c, digits).alias(c)


def _peers(spark, f):
    """task (nation), readout (priority), source (customer), value; the smallest customer is the review itself."""
    o = table(spark, f, "orders").groupBy("o_custkey", "o_orderpriority").agg((F.avg("o_totalprice") / 500000).alias("value"))
    c = table(spark, f, "customer").select("c_custkey", "c_nationkey")
    self_ = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("me"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(self_), "c_nationkey")
    return joined.select(C("c_nationkey").alias("task"), C("o_orderpriority").alias("readout"), C("o_custkey").alias("source"), (C("o_custkey") == C("me")).alias("is_self"), "value")


def _values(spark, f):
    """system (segment) values per (task, readout) with direction and family."""
    o = table(spark, f, "orders")
    c = table(spark, f, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    v = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "c_nationkey", "o_orderpriority").agg((F.max("o_totalprice") / 500000).alias("v"))
    p = C("o_orderpriority")
    direction = F.when(p.substr(1, 1).isin("1", "2", "3"), "quality").otherwise("style")
    family = F.when(p.substr(1, 1) == "3", "task").otherwise("claim")
    return v.select(C("c_mktsegment").alias("system"), C("c_nationkey").alias("task"), p.alias("readout"), direction.alias("direction"), family.alias("family"), F.when((C("c_nationkey") % 7 != 0), C("v")).alias("value"))


def d01_calibration(spark, f):
    return S.calibration(_peers(spark, f)).select("task", "readout", "n_peers", *map(_r, ["own", "q_lo", "q_hi", "median", "peer_sd"]))


def d02_normalise(spark, f):
    return S.normalise(_values(spark, f), S.calibration(_peers(spark, f))).select("system", "task", "readout", _r("z"), "z_note")


def d03_discriminability(spark, f):
    return S.discriminability(_peers(spark, f)).select("readout", _r("gap"), _r("peer_sd"), "n")


def d04_tolerances(spark, f):
    return S.tolerances(_peers(spark, f)).select("readout", _r("eps"), "n_pairs", "admissible")


def d05_regime(spark, f):
    tol = S.tolerances(_peers(spark, f))
    pairs = table(spark, f, "nation").select(C("n_nationkey").alias("pair"), (C("n_regionkey") != 0).alias("same_model"), F.when(C("n_nationkey") % 5 != 0, C("n_nationkey") / 40).alias("xi"))
    rule = F.when(~C("same_model"), "cross_model").when(C("xi").isNull(), "no_estimate").when(C("xi") == 0, "exact").when(~C("admissible"), "no_tolerance").when(C("xi") > C("eps"), "tolerance").otherwise("fair")
    return pairs.crossJoin(F.broadcast(tol)).select("pair", "readout", rule.alias("regime"))


def d07_contrasts(spark, f):
    return S.contrasts(D.scores(spark, f), DELTA, 0.001).select("a", "b", "n", "k", *map(_r, ["ours", "opp", "diff", "se", "q"]), "certified", "status")


def d10_composite(spark, f):
    axes = table(spark, f, "orders").groupBy(C("o_orderpriority").alias("system"), (C("o_custkey") % 50).alias("task"), C("o_orderstatus").alias("axis")).agg((F.avg("o_totalprice") / 500000).alias("z"))
    return S.composite(axes).select("system", "task", _r("composite"), "n_axes", "agree")


def d11_leaderboard(spark, f):
    return S.leaderboard(_shifted(spark, f), DELTA).select("name", _r("mean"), "best", "worst")


def _shifted(spark, f):
    """The scores with a different offset per system, so that some contrasts are decided."""
    return D.scores(spark, f).withColumn("z", C("z") + C("system").substr(1, 1).cast("int") * 0.02)


def d12_certified_closure(spark, f):
    decided = S.contrasts(_shifted(spark, f), DELTA / 10).where("certified")
    rel = decided.select(F.when(C("diff") > 0, C("a")).otherwise(C("b")).alias("src"), F.when(C("diff") > 0, C("b")).otherwise(C("a")).alias("dst"))
    return closure(rel)


def g13_tierable(spark, f):
    names = D.scores(spark, f).select(C("system").alias("name")).distinct()
    decided = S.contrasts(_shifted(spark, f), DELTA / 10).where("certified")
    rel = decided.select(F.when(C("diff") > 0, C("a")).otherwise(C("b")).alias("src"), F.when(C("diff") > 0, C("b")).otherwise(C("a")).alias("dst"))
    return tierable(names, rel)


def d14_rule_ladder(spark, f):
    plain = S.contrasts(_shifted(spark, f).withColumn("cluster", C("task")), DELTA).select("a", "b", C("certified").alias("naive"))
    out = plain
    for name, delta, eps in (("clustered", DELTA, 0.0), ("all_pairs", DELTA / 10, 0.0), ("with_radius", DELTA / 10, 0.01)):
        out = out.join(S.contrasts(_shifted(spark, f), delta, eps).select("a", "b", C("certified").alias(name)), ["a", "b"])
    return out


def d15_leave_one_cluster_out(spark, f):
    s = _shifted(spark, f)
    left = s.select("task", "cluster", C("system").alias("a"), C("z").alias("za"))
    d = left.join(s.select("task", C("system").alias("b"), C("z").alias("zb")), "task").where("a < b")
    per = d.groupBy("a", "b", "cluster").agg(F.sum(C("za") - C("zb")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("a", "b").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    j = per.join(whole, ["a", "b"])
    rest = (C("all_s") - C("s")) / (C("all_n") - C("n"))
    return j.groupBy("a", "b").agg(F.count_if(F.signum(rest) != F.signum(C("all_s") / C("all_n"))).alias("flips"), F.count(F.lit(1)).alias("folds"))


def d16_sign_flip(spark, f):
    s = D.scores(spark, f)
    d = s.select("task", "cluster", C("system").alias("a"), C("z").alias("za")).join(s.select("task", C("system").alias("b"), C("z").alias("zb")), "task").where("a < b")
    return S.sign_flip(d.select("a", "b", "cluster", (C("za") - C("zb")).alias("d")), ["a", "b"], 200).select("a", "b", _r("statistic"), _r("exceed"))


def d30_pivot(spark, f):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = D.scores(spark, f).groupBy("cluster").pivot("system", names).agg(F.round(F.avg("z"), 6))
    return wide.select("cluster", *[C(f"`{n}`").alias(f"s{n[0]}") for n in names])


def d33_board_export(spark, f):
    return D.scores(spark, f).groupBy("system").agg(F.round(F.avg("z"), 4).alias("mean_z"), F.countDistinct("task").alias("tasks"), F.countDistinct("cluster").alias("clusters"))


def d34_assemble(spark, f):
    """Two views of the board put together; rows that both have must agree."""
    s = D.scores(spark, f).withColumn("z", F.round("z", 6))
    one, two = s.where("cluster < 15"), s.where("cluster >= 10")
    both = one.join(two.withColumnRenamed("z", "z2"), ["system", "task", "cluster"]).where("z <> z2")
    merged = one.unionByName(two).distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    bad = both.groupBy("cluster").agg(F.count(F.lit(1)).alias("conflicts"))
    return merged.join(bad, "cluster", "left").select("cluster", "rows", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def d35_best_marks(spark, f):
    from pyspark.sql import Window

    means = D.scores(spark, f).groupBy("cluster", "system").agg(F.round(F.avg("z"), 4).alias("z"))
    rank = F.dense_rank().over(Window.partitionBy("cluster").orderBy(C("z").desc()))
    return means.withColumn("r", rank).select("cluster", "system", "z", F.when(C("r") == 1, "best").when(C("r") == 2, "second").otherwise("").alias("mark"))


def d36_melt(spark, f):
    wide = table(spark, f, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"))
    return wide.unpivot("l_returnflag", ["quantity", "discount", "tax"], "readout", "value").select(C("l_returnflag").alias("system"), "readout", F.round("value", 6).alias("value"))


def d38_family_failures(spark, f):
    runs = table(spark, f, "orders").select(C("o_custkey").alias("task"), C("o_orderpriority").alias("seed"), (C("o_orderstatus") == "F").alias("failed")).groupBy("task", "seed").agg(F.every("failed").alias("failed"))
    return runs.groupBy("task").agg((F.count_if("failed") == F.count(F.lit(1))).alias("family_failed"), F.count(F.lit(1)).alias("seeds")).where("family_failed").select("task", "seeds")


def d39_family_series(spark, f):
    runs = table(spark, f, "orders").select((C("o_custkey") % 100).alias("task"), C("o_orderpriority").alias("seed"), F.when(C("o_orderstatus") != "F", C("o_totalprice") / 500000).alias("z"))
    seeds = runs.groupBy("task", "seed").agg(F.avg("z").alias("z"))
    return seeds.groupBy("task").agg(F.round(F.avg("z"), 6).alias("z"), F.count("z").alias("seeds"))


def d40_exclusion(spark, f):
    b = S.calibration(_peers(spark, f))
    rule = F.when(C("n_peers") < 2, "channel_defect").when((C("own") >= 0.999) & (C("q_lo") >= 0.999), "guardrail").when(C("own").isNull(), "no_topical_signal").when(C("median") > 0.6, "saturated").when(C("peer_sd") < 0.1, "non_discriminating").otherwise("kept")
    return b.groupBy("readout", rule.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_PEERS = "o AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) / 500000 AS value FROM orders GROUP BY ALL), me AS (SELECT c_nationkey, min(c_custkey) AS me FROM customer GROUP BY 1), peers AS (SELECT c.c_nationkey AS task, o_orderpriority AS readout, o_custkey AS source, o_custkey = me AS is_self, value FROM o JOIN customer c ON c_custkey = o_custkey JOIN me USING (c_nationkey)), cal AS (SELECT task, readout, max(value) FILTER (is_self) AS own, quantile_cont(value, 0.1) FILTER (NOT is_self) AS q_lo, quantile_cont(value, 0.9) FILTER (NOT is_self) AS q_hi, quantile_cont(value, 0.5) FILTER (NOT is_self) AS median, count(*) FILTER (NOT is_self) AS n_peers, CASE WHEN count(*) FILTER (NOT is_self) > 1 THEN stddev_pop(value) FILTER (NOT is_self) END AS peer_sd FROM peers GROUP BY ALL)"


def _contrast_sql(score: str, delta: float, eps: float, name: str, most: int = 25) -> str:
    return f"""{name}_d AS (SELECT x.cluster, x.system AS a, y.system AS b, x.z AS za, y.z AS zb FROM {score} x JOIN {score} y ON x.task = y.task AND x.system < y.system),
{name}_p AS (SELECT a, b, cluster, count(*) AS n, sum(za - zb) AS d, sum(za) AS sa, sum(zb) AS sb, max(abs(za - zb)) AS m FROM {name}_d GROUP BY ALL),
{name}_t AS (SELECT a, b, sum(n) AS n, count(*) AS k, sum(d) AS td, sum(sa) / sum(n) AS ours, sum(sb) / sum(n) AS opp, max(m) AS m FROM {name}_p GROUP BY ALL),
{name}_s AS (SELECT p.a, p.b, sum((p.d - p.n * t.td / t.n) ** 2) AS ssq FROM {name}_p p JOIN {name}_t t USING (a, b) GROUP BY ALL),
{name}_q AS (SELECT * FROM (VALUES {", ".join(f"({k}, {t_quantile(1 - delta / 2, k - 1)!r})" for k in range(2, most + 1))}) v(k, tq)),
{name}_e AS (SELECT *, td / n AS diff, sqrt(k / (k - 1) * ssq) / n AS se, tq * sqrt(k / (k - 1) * ssq) / n AS q FROM {name}_t JOIN {name}_s USING (a, b) LEFT JOIN {name}_q USING (k)),
{name} AS (SELECT a, b, CAST(n AS BIGINT) AS n, k, ours, opp, diff, CASE WHEN n >= 10 AND k >= 2 THEN se END AS se, CASE WHEN n >= 10 AND k >= 2 THEN q END AS q, coalesce(n >= 10 AND k >= 2 AND m <> 0 AND abs(diff) > q + {eps}, false) AS certified, CASE WHEN n < 10 THEN 'too_few_tasks' WHEN k < 2 THEN 'too_few_clusters' WHEN m = 0 THEN 'tie_identical' WHEN abs(diff) > q + {eps} THEN 'decided' ELSE 'undecided' END AS status FROM {name}_e)"""


_SHIFTED = f"{D.with_sql('score', recursive=True)}, sh AS (SELECT system, task, cluster, z + CAST(substr(system, 1, 1) AS INT) * 0.02 AS z FROM score)"
_REL = f"{_SHIFTED}, {_contrast_sql('sh', DELTA / 10, 0.0, 'c')}, rel AS (SELECT CASE WHEN diff > 0 THEN a ELSE b END AS src, CASE WHEN diff > 0 THEN b ELSE a END AS dst FROM c WHERE certified), reach AS (SELECT src, dst FROM rel UNION SELECT r.src, e.dst FROM reach r JOIN rel e ON r.dst = e.src), names AS (SELECT DISTINCT system AS name FROM score)"

ORACLE = {
    "d01_calibration": f"WITH {_PEERS} SELECT task, readout, n_peers, round(own, 6) AS own, round(q_lo, 6) AS q_lo, round(q_hi, 6) AS q_hi, round(median, 6) AS median, round(peer_sd, 6) AS peer_sd FROM cal",
    "d02_normalise": f"""WITH {_PEERS}, v AS (SELECT c_mktsegment AS system, c_nationkey AS task, o_orderpriority AS readout, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 'quality' ELSE 'style' END AS direction, CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'task' ELSE 'claim' END AS family, CASE WHEN c_nationkey % 7 <> 0 THEN max(o_totalprice) / 500000 END AS val FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, c_nationkey, o_orderpriority),
j AS (SELECT system, task, readout, direction, family, val AS v, own, q_lo, q_hi, CASE WHEN own > q_lo THEN own ELSE greatest(coalesce(own, -1), q_hi) END AS ceil, CASE WHEN val < q_lo THEN q_lo - val WHEN val > q_hi THEN val - q_hi ELSE 0 END AS off FROM v LEFT JOIN cal USING (task, readout))
SELECT system, task, readout, round(CASE WHEN v IS NULL THEN NULL WHEN family = 'task' THEN v WHEN direction = 'quality' AND own >= 0.999 AND q_lo >= 0.999 THEN least(1, greatest(0, v)) WHEN direction = 'quality' AND q_lo IS NULL AND (own IS NULL OR own <= 0) THEN NULL WHEN direction = 'quality' AND q_lo IS NULL THEN least(1, greatest(0, v / own)) WHEN direction = 'quality' AND ceil <= q_lo THEN NULL WHEN direction = 'quality' THEN least(1, greatest(0, (v - q_lo) / (ceil - q_lo))) WHEN (q_lo IS NULL OR q_hi IS NULL) AND own IS NULL THEN NULL WHEN q_lo IS NULL OR q_hi IS NULL THEN greatest(0, 1 - abs(v - own)) ELSE 1 - least(1, off / greatest(q_hi - q_lo, 0.05)) END, 6) AS z,
CASE WHEN v IS NULL THEN 'bot' WHEN family = 'task' THEN 'pass_through' WHEN direction = 'quality' AND own >= 0.999 AND q_lo >= 0.999 THEN 'guardrail' WHEN direction = 'quality' AND q_lo IS NULL AND (own IS NULL OR own <= 0) THEN 'no_calibration' WHEN direction = 'quality' AND q_lo IS NULL THEN 'no_peers' WHEN direction = 'quality' AND ceil <= q_lo THEN 'non_discriminating_task' WHEN direction = 'quality' THEN '' WHEN (q_lo IS NULL OR q_hi IS NULL) AND own IS NULL THEN 'no_calibration' WHEN q_lo IS NULL OR q_hi IS NULL THEN 'no_peers' ELSE '' END AS z_note FROM j""",
    "d03_discriminability": f"WITH {_PEERS} SELECT readout, round(quantile_cont(abs(own - median), 0.5), 6) AS gap, round(avg(peer_sd), 6) AS peer_sd, count(*) AS n FROM cal GROUP BY readout",
    "d04_tolerances": f"WITH {_PEERS}, g AS (SELECT p.readout, abs(p.value - s.value) AS gap FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self), t AS (SELECT readout, quantile_cont(gap, 0.5) AS eps, count(*) AS n_pairs FROM g GROUP BY readout) SELECT readout, round(eps, 6) AS eps, n_pairs, eps > 0 AND eps < 0.5 AS admissible FROM t",
    "d05_regime": f"WITH {_PEERS}, g AS (SELECT p.readout, abs(p.value - s.value) AS gap FROM peers p JOIN peers s ON s.is_self AND s.task = p.task AND s.readout = p.readout WHERE NOT p.is_self), t AS (SELECT readout, quantile_cont(gap, 0.5) AS eps FROM g GROUP BY readout), p AS (SELECT n_nationkey AS pair, n_regionkey <> 0 AS same_model, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey / 40 END AS xi FROM nation) SELECT pair, readout, CASE WHEN NOT same_model THEN 'cross_model' WHEN xi IS NULL THEN 'no_estimate' WHEN xi = 0 THEN 'exact' WHEN NOT (eps > 0 AND eps < 0.5) THEN 'no_tolerance' WHEN xi > eps THEN 'tolerance' ELSE 'fair' END AS regime FROM p, t",
    "d07_contrasts": f"{D.with_sql('score')}, {_contrast_sql('score', DELTA, 0.001, 'c')} SELECT a, b, n, k, round(ours, 6) AS ours, round(opp, 6) AS opp, round(diff, 6) AS diff, round(se, 6) AS se, round(q, 6) AS q, certified, status FROM c",
    "d10_composite": "WITH a AS (SELECT o_orderpriority AS system, o_custkey % 50 AS task, o_orderstatus AS axis, avg(o_totalprice) / 500000 AS z FROM orders GROUP BY ALL), p AS (SELECT system, task, avg(z) AS composite, count(*) AS n_axes, string_agg(axis, ',' ORDER BY axis) AS s FROM a GROUP BY ALL) SELECT system, task, round(composite, 6) AS composite, n_axes, (SELECT count(DISTINCT s) = 1 FROM p q WHERE q.task = p.task) AS agree FROM p",
    "d11_leaderboard": f"{_REL} SELECT name, (SELECT round(avg(z), 6) FROM sh WHERE system = name) AS mean, 1 + (SELECT count(*) FROM reach WHERE dst = name AND src <> name) AS best, (SELECT count(*) FROM names) - (SELECT count(*) FROM reach WHERE src = name AND dst <> name) AS worst FROM names",
    "d12_certified_closure": f"{_REL} SELECT src, dst FROM reach",
    "g13_tierable": f"{_REL}, un AS (SELECT x.name AS x, y.name AS y FROM names x, names y WHERE x.name <> y.name AND NOT EXISTS (SELECT 1 FROM reach WHERE (src = x.name AND dst = y.name) OR (src = y.name AND dst = x.name))) SELECT count(*) = 0 AS tierable FROM un p JOIN un q ON p.y = q.x WHERE p.x <> q.y AND NOT EXISTS (SELECT 1 FROM un r WHERE r.x = p.x AND r.y = q.y)",
    "d14_rule_ladder": f"{_SHIFTED}, tasked AS (SELECT system, task, task AS cluster, z FROM sh), {_contrast_sql('tasked', DELTA, 0.0, 'c0', 1600)}, {_contrast_sql('sh', DELTA, 0.0, 'c1')}, {_contrast_sql('sh', DELTA / 10, 0.0, 'c2')}, {_contrast_sql('sh', DELTA / 10, 0.01, 'c3')} SELECT a, b, c0.certified AS naive, c1.certified AS clustered, c2.certified AS all_pairs, c3.certified AS with_radius FROM c0 JOIN c1 USING (a, b) JOIN c2 USING (a, b) JOIN c3 USING (a, b)",
    "d15_leave_one_cluster_out": f"{_SHIFTED}, p AS (SELECT x.system AS a, y.system AS b, x.cluster, sum(x.z - y.z) AS s, count(*) AS n FROM sh x JOIN sh y ON x.task = y.task AND x.system < y.system GROUP BY ALL), fo AS (SELECT DISTINCT cluster AS fold FROM sh), r AS (SELECT a, b, fold, sum(s) / sum(n) AS m FROM p, fo WHERE cluster <> fold GROUP BY ALL), w AS (SELECT a, b, sum(s) / sum(n) AS m FROM p GROUP BY ALL) SELECT a, b, count(*) FILTER (sign(r.m) <> sign(w.m)) AS flips, count(*) AS folds FROM r JOIN w USING (a, b) GROUP BY a, b",
    "d16_sign_flip": f"{D.with_sql('score')}, p AS (SELECT x.system AS a, y.system AS b, x.cluster, sum(x.z - y.z) AS s, count(*) AS n FROM score x JOIN score y ON x.task = y.task AND x.system < y.system GROUP BY ALL), r AS (SELECT a, b, rep, abs(sum(s * CASE WHEN CAST('0x' || md5('flip:' || rep || ':' || cluster)[1:2] AS INT) % 2 = 0 THEN 1 ELSE -1 END) / sum(n)) AS m FROM p, range(200) t(rep) GROUP BY ALL), w AS (SELECT a, b, abs(sum(s) / sum(n)) AS statistic FROM p GROUP BY ALL) SELECT a, b, round(statistic, 6) AS statistic, round(avg(CAST(m >= statistic - 1e-12 AS INT)), 6) AS exceed FROM r JOIN w USING (a, b) GROUP BY a, b, statistic",
    "d30_pivot": f"{D.with_sql('score')} SELECT cluster, " + ", ".join(f"round(avg(z) FILTER (system LIKE '{k}-%'), 6) AS s{k}" for k in range(1, 6)) + " FROM score GROUP BY cluster",
    "d33_board_export": f"{D.with_sql('score')} SELECT system, round(avg(z), 4) AS mean_z, count(DISTINCT task) AS tasks, count(DISTINCT cluster) AS clusters FROM score GROUP BY system",
    "d34_assemble": f"{D.with_sql('score')} SELECT cluster, count(*) AS rows, 0 AS conflicts FROM score GROUP BY cluster",
    "d35_best_marks": f"{D.with_sql('score')}, m AS (SELECT cluster, system, round(avg(z), 4) AS z FROM score GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY cluster ORDER BY z DESC) AS r FROM m) SELECT cluster, system, z, CASE r WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark FROM r",
    "d36_melt": "WITH w AS (SELECT l_returnflag AS system, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1) SELECT system, readout, round(value, 6) AS value FROM (UNPIVOT w ON quantity, discount, tax INTO NAME readout VALUE value)",
    "d38_family_failures": "WITH r AS (SELECT o_custkey AS task, o_orderpriority AS seed, bool_and(o_orderstatus = 'F') AS failed FROM orders GROUP BY ALL) SELECT task, count(*) AS seeds FROM r GROUP BY task HAVING bool_and(failed)",
    "d39_family_series": "WITH s AS (SELECT o_custkey % 100 AS task, o_orderpriority AS seed, avg(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 500000 END) AS z FROM orders GROUP BY ALL) SELECT task, round(avg(z), 6) AS z, count(z) AS seeds FROM s GROUP BY task",
    "d40_exclusion": f"WITH {_PEERS} SELECT readout, CASE WHEN n_peers < 2 THEN 'channel_defect' WHEN own >= 0.999 AND q_lo >= 0.999 THEN 'guardrail' WHEN own IS NULL THEN 'no_topical_signal' WHEN median > 0.6 THEN 'saturated' WHEN peer_sd < 0.1 THEN 'non_discriminating' ELSE 'kept' END AS reason, count(*) AS n FROM cal GROUP BY 1, 2",
}
QUERIES = {n: globals()[n] for n in ORACLE}
