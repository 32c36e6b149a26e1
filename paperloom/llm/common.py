"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import Workspace


#: Estimated bytes per partition from which AQE's own partitions keep all cores busy.
ENOUGH_BYTES = 64 << 20


def spread(df: DataFrame, *keys: str, together: bool = False) -> DataFrame:
    """``df`` hashed by ``keys``, of which none may be hot, over all cores, if it is small.

    Python stages cost CPU rather than bytes, so the few partitions that AQE makes of a small result
    would leave cores idle.  A large result has partitions enough and is left as it is, or with
    ``together``, where rows of a key must meet, dealt by key into as many as AQE finds right.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= n * ENOUGH_BYTES:
        return df.repartition(n, *keys)
    return df.repartition(*keys) if together else df


#: Logical operators that shuffle; asking such a plan for its partitions would run it.
_SHUFFLES = re.compile(r"\b(Aggregate|Join|Sort|Window|Repartition\w*|RebalancePartitions|Distinct|Deduplicate\w*|Intersect|Except)\b")


def at_least_parallel(df: DataFrame) -> DataFrame:
    """A mere scan as it is if it has a partition per core, else dealt out evenly.

    A large table never moves; a table of one small file is split, since the Python stage that
    follows would otherwise run on one core.  A plan that shuffles is left as it is: its maker
    decides on its partitions, as ``spread`` does.
    """
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ranked(df: DataFrame, order: list, name: str, work: Workspace) -> DataFrame:
    """``df`` with ``name``: its 0-based place in the order of all rows, found without one big task.

    Rows are dealt by ranges of ``order`` and sorted within them; the places follow from the number
    of rows of each range.  ``order`` must end in a key, so that no tie is a hot range.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    local = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = work.write(dealt.withColumns({"_part": F.shiftright(local, 33), "_row": local.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    begin = spark.createDataFrame(offsets, "_part long, _begin long")  # one row per partition
    return kept.join(F.broadcast(begin), "_part").withColumn(name, F.col("_begin") + F.col("_row")).drop("_part", "_row", "_begin")
