"""Readers of the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: str = "loaded_at") -> DataFrame:
    """One row per key: that of the greatest ``order`` (nulls last), ties by the row's content.

    A partial aggregate runs before the shuffle, so a key delivered many times moves once per
    partition.  A null key is a key of its own.  Columns keep their names and order.
    """
    rest = [c for c in df.columns if c not in keys]
    # Maps can't be compared; they ride along outside the comparison.
    comparable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    rank = F.struct(*([F.col(order)] if order in rest else []), *[F.col(c) for c in comparable])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])
