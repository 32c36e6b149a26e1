"""Joins that hold when one key has a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many keys are treated as hot, whatever the input: a key is hot only if it holds
#: more than 1/MAX_HOT of the rows, so no more than MAX_HOT keys can be.
MAX_HOT = 256
#: Below this count no key is worth a plan of its own.
LEAST_HOT_ROWS = 200_000


def hot_keys(df: DataFrame, on: list[str], n_rows: int, least: int = LEAST_HOT_ROWS) -> DataFrame | None:
    """The keys with more than max(n_rows / MAX_HOT, least) rows, or None if there can't be any."""
    limit = max(n_rows // MAX_HOT, least)
    if n_rows <= limit:
        return None
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > limit).select(*on).collect()  # at most MAX_HOT rows
    schema = df.select(*on).schema
    return df.sparkSession.createDataFrame(found, schema) if found else None


def lookup_join(many: DataFrame, one: DataFrame, on: list[str], n_rows: int, how: str = "left", least: int = LEAST_HOT_ROWS) -> DataFrame:
    """``many`` joined to at most one row of ``one`` per key, hot keys of ``many`` by broadcast.

    The rows of ``one`` for hot keys number at most MAX_HOT, so their broadcast is bounded; all
    other keys go through an ordinary shuffled join.  Keys must be null-free or match nothing.
    """
    hot = hot_keys(many, on, n_rows, least)
    if hot is None:
        return many.join(one, on, how)
    hot = F.broadcast(hot)
    parts = [
        many.join(hot, on, "left_semi").join(F.broadcast(one.join(hot, on, "left_semi")), on, how),
        many.join(hot, on, "left_anti").join(one, on, how),
    ]
    return reduce(DataFrame.unionByName, parts)
