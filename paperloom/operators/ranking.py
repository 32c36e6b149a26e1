"""Rankings, quotas, budgets and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their ``rank`` from 1.

    Spark limits each partition's groups before the shuffle, so a large group moves k rows per task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, found by a partial aggregate instead of a sort.

    ``order`` must be columns of which the smallest comes first, and must not tie.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def fit_to_budget(df: DataFrame, by: list[str], order: list, size: Column, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes stay within ``budget``; the first row always stays.

    Adds ``upto``, the running size.  Rows of equal order count together.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"upto": F.sum(size).over(w), "_rn": F.row_number().over(w)}).where((F.col("_rn") == 1) | (F.col("upto") <= budget)).drop("_rn")


def whole_until(df: DataFrame, by: list[str], order: list, size: Column, target: int) -> DataFrame:
    """Whole rows of each group up to and with the first at which the running size reaches ``target``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_before", F.sum(size).over(w) - size).where(F.col("_before") < target).drop("_before")


def round_robin(df: DataFrame, group: list[str], inside: list[Column], outer: list[str], n: int | None = None) -> DataFrame:
    """Rows taken from the groups in turn: every group's first, then every group's second, and so on.

    Adds ``round`` (from 1); with ``n`` only the first n rows stay, in order of (round, ``outer``).
    """
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(*group).orderBy(*inside)))
    return ranked if n is None else ranked.orderBy("round", *outer).limit(n)


def largest_remainder(groups: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """``key``, ``seats``: seats in proportion to ``weight``, what is left by largest remainder, ties by key.

    ``groups`` has one row per group; their number must be small (strata, clusters, windows).
    """
    whole = Window.partitionBy(F.lit(1))
    share = F.col(weight) * seats / F.sum(weight).over(whole)
    parts = groups.select(key, F.floor(share).alias("_base"), (share - F.floor(share)).alias("_frac"))
    ranked = parts.withColumns({"_rn": F.row_number().over(whole.orderBy(F.round("_frac", 9).desc(), key)), "_left": F.lit(seats) - F.sum("_base").over(whole)})
    return ranked.select(key, (F.col("_base") + (F.col("_rn") <= F.col("_left")).cast("long")).alias("seats"))


def islands(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal ``value``: (by, ``value``, first, last, n) of each run in ``order``."""
    w = Window.partitionBy(*by).orderBy(order)
    start = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_start", start).withColumn("_island", F.sum("_start").over(w))
    return runs.groupBy(*by, "_island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")
