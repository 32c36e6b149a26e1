"""Citation and claim graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import Workspace


def clean_edges(edges: DataFrame) -> DataFrame:
    """src, dst once each, without loops and null ends."""
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row: n_raw, n_loops, n_repeats, n_edges."""
    per = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    loop, edge = F.col("src") == F.col("dst"), F.col("src") != F.col("dst")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = per.agg(zero(F.sum("n")).alias("n_raw"), zero(F.sum(F.when(loop, F.col("n")))).alias("n_loops"), F.count_if(edge).alias("n_edges"))
    return sums.select("n_raw", "n_loops", (F.col("n_raw") - F.col("n_loops") - F.col("n_edges")).alias("n_repeats"), "n_edges")


def adjacency(edges: DataFrame, start: str = "src", end: str = "dst", most: int = 50_000) -> DataFrame:
    """``start``, degree and the first ``most`` neighbours in ascending order.

    The bound is part of the feature; ``clean_edges`` keeps every edge.  A partial row_number limit
    runs before the shuffle, so that a hub's list is bounded in every task.
    """
    degree = edges.groupBy(start).agg(F.count(F.lit(1)).alias("degree"))
    ranked = edges.withColumn("_rn", F.row_number().over(Window.partitionBy(start).orderBy(end))).where(F.col("_rn") <= most)
    lists = ranked.groupBy(start).agg(F.sort_array(F.collect_list(end)).alias("neighbours"))
    return degree.join(lists, start)


def adjacency_blocks(edges: DataFrame, start: str = "src", end: str = "dst", length: int = 50_000) -> DataFrame:
    """``start``, block, degree, neighbours: every neighbour in ascending order, ``length`` to a block.

    Blocks are numbered from 0 in the order of their neighbours.  Edges are numbered by range
    partitions, so that a hub's rows are sorted by as many tasks as they fill.
    """
    dealt = edges.select(start, end).repartitionByRange(start, end).withColumn("_pid", F.spark_partition_id())
    rows = Workspace(edges.sparkSession, "adjacency").write(dealt)
    whole = Window.partitionBy(start)
    parts = rows.groupBy(start, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(start, "_pid", before.alias("_before"), F.sum("_n").over(whole).alias("degree"))
    at = F.row_number().over(Window.partitionBy(start, "_pid").orderBy(end)) - 1
    placed = rows.withColumn("_at", at).join(parts, [start, "_pid"]).withColumn("block", F.floor((F.col("_before") + F.col("_at")) / length))
    return placed.groupBy(start, "block").agg(F.first("degree").alias("degree"), F.sort_array(F.collect_list(end)).alias("neighbours"))


def citation_counts(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``key``, n_citation: the known count, else the number of citing papers; 0 if there are none."""
    cited = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_deg"))
    joined = known.join(cited, known[key] == cited["dst"], "left")
    return joined.select(key, F.coalesce("n_citation", "_deg", F.lit(0)).cast("long").alias("n_citation"))


def visible_neighbours(edges: DataFrame, years: DataFrame, asked: DataFrame, scan: int = 50_000) -> DataFrame:
    """qid, id, neighbour: cited papers a question may see: dated, not after its cutoff, not its review.

    Of each node the first ``scan`` neighbours are looked at before the rule applies.
    """
    near = edges.withColumn("_rn", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_rn") <= scan)
    joined = asked.join(near, asked["id"] == near["src"]).join(years, near["dst"] == years["id"]).select(asked["qid"], asked["id"], asked["cutoff"], asked["review"], near["dst"].alias("neighbour"), years["year"])
    return joined.where((F.col("year") <= F.col("cutoff")) & ~F.col("neighbour").eqNullSafe(F.col("review"))).select("qid", "id", "neighbour")


def authority(edges: DataFrame, years: DataFrame, candidates: DataFrame) -> DataFrame:
    """qid, id, citers, degree: citing papers dated before the cutoff's year, and all of them."""
    cited = edges.join(years.select(F.col("id").alias("src"), F.col("year").alias("citer_year")), "src", "left")
    joined = candidates.join(cited, candidates["id"] == cited["dst"], "left")
    before = F.count_if(F.col("citer_year") <= F.col("cutoff") - 1)
    return joined.groupBy("qid", "id").agg(before.alias("citers"), F.count("src").alias("degree"))


def two_hop_paths(edges: DataFrame, kind: Column | None = None) -> DataFrame:
    """a, b, c of directed paths over three different nodes, with the kinds of both edges.

    Parallel edges must be folded before; a and c differ.
    """
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("first"))
    two = edges.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("type").alias("second"))
    return one.join(two, "b").where("a <> c").select("a", "b", "c", "first", "second")


def motif_paths(edges: DataFrame, by: str, kinds: Column, per_start: int = 50, per_kind: int = 200) -> DataFrame:
    """``by``, kind, a, b, c: paths over three nodes of each graph that make a motif.

    ``edges`` has ``by``, src, dst, type and at (the order in which a node's successors came); of parallel
    edges the last type and the first place hold.  ``kinds`` names the motif of a path by its types
    first and second, null for none.  A start gives its ``per_start`` first paths, latest successors
    first, and a graph the ``per_kind`` smallest paths of each kind; both limits are part of the motif.
    """
    one = edges.where("src <> dst").groupBy(by, "src", "dst").agg(F.max_by("type", "at").alias("type"), F.min("at").alias("at"))
    p = one.select(by, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("first"), F.col("at").alias("_p"))
    q = one.select(by, F.col("src").alias("b"), F.col("dst").alias("c"), F.col("type").alias("second"), F.col("at").alias("_q"))
    start = Window.partitionBy(by, "a").orderBy(F.col("_p").desc(), F.col("_q").desc())
    kept = p.join(q, [by, "b"]).where("a <> c").withColumn("_r", F.row_number().over(start)).where(F.col("_r") <= per_start)
    named = kept.select(by, kinds.alias("kind"), "a", "b", "c").where("kind is not null").distinct()
    rank = F.row_number().over(Window.partitionBy(by, "kind").orderBy("a", "b", "c"))
    return named.withColumn("_r", rank).where(F.col("_r") <= per_kind).drop("_r")


def closure(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """src, dst of all pairs that a path connects; meant for relations over few nodes (systems, arms).

    Path lengths double each round; a pair (x, x) shows a cycle.
    """
    work = Workspace(edges.sparkSession, "closure")
    known = work.write(edges.select("src", "dst").distinct())
    n = known.count()
    for _ in range(rounds):
        hop = known.alias("p").join(known.alias("q"), F.col("p.dst") == F.col("q.src")).select(F.col("p.src").alias("src"), F.col("q.dst").alias("dst"))
        known = work.write(known.union(hop).distinct())
        now = known.count()
        if now == n:
            break
        n = now
    return known


def rank_intervals(names: DataFrame, relation: DataFrame) -> DataFrame:
    """name, best, worst: ranks that a certified order leaves open, over its closure.

    ``relation`` has rows (src above dst).  best = 1 + those above, worst = n - those below.
    """
    reach = closure(relation)
    above = reach.where("src <> dst").groupBy("dst").agg(F.count(F.lit(1)).alias("_above"))
    below = reach.where("src <> dst").groupBy("src").agg(F.count(F.lit(1)).alias("_below"))
    joined = names.join(above, names["name"] == above["dst"], "left").join(below, names["name"] == below["src"], "left").withColumn("_n", F.lit(names.count()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("name", (1 + zero(F.col("_above"))).alias("best"), (F.col("_n") - zero(F.col("_below"))).alias("worst"))


def tierable(names: DataFrame, relation: DataFrame) -> DataFrame:
    """One row, tierable: whether being unordered is transitive over all triples of names."""
    reach = closure(relation)
    # Names are systems or arms, of which there are few.
    pairs = names.select(F.col("name").alias("x")).join(names.select(F.col("name").alias("y")), F.col("x") != F.col("y"))
    ordered = reach.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(reach.select("dst", "src")).distinct()
    free = pairs.join(ordered, ["x", "y"], "left_anti")
    ab, bc = free.select(F.col("x").alias("a"), F.col("y").alias("b")), free.select(F.col("x").alias("b"), F.col("y").alias("c"))
    bad = ab.join(bc, "b").where("a <> c").join(ordered.select(F.col("x").alias("a"), F.col("y").alias("c")), ["a", "c"], "left_semi")
    return bad.agg((F.count(F.lit(1)) == 0).alias("tierable"))
