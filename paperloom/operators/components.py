"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import LEAST_HOT_ROWS, lookup_join
from paperloom.session import Workspace


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 30))), F.lit(0))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str, work: Workspace, hot_rows: int = LEAST_HOT_ROWS) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its least node.

    Minima are aggregated before they are joined back, and hubs are looked up by broadcast, so a
    node with a large part of all edges is no unbounded group.  Rounds grow with the logarithm of
    the number of nodes.  Null ends and loops are no edges; an empty table gives an empty result.
    """
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    now = work.write(start)
    mark = _mark(now)
    while mark[0]:
        n = 2 * mark[0]
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = lookup_join(both.where("v > u"), least, ["u"], n, "inner", hot_rows).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = work.write(large.where("hi <> lo").distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = lookup_join(large, least, ["hi"], n, "inner", hot_rows)
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least.select("hi", F.col("m").alias("lo")))
        after = work.write(small.distinct())
        mark, before = _mark(after), mark
        work.drop(large)
        now = after
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())
