"""Queries of problem 4: papers packed into prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.packing import fill, pack
from paperloom.session import Workspace
from paperloom.sources.tables import latest, table


def _capacities(spark: SparkSession, folder: str) -> dict[str, int]:
    """The capacities by name; pack_caps is a table of a few rows that does not grow."""
    caps = table(spark, folder, "pack_caps").where("capacity_chars > 0")
    return {r.cap_name: r.capacity_chars for r in caps.collect()}


def p4_packed(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers")
    length = F.length(F.coalesce("title", F.lit(""))) + 1 + F.length(F.coalesce("abs", F.lit("")))
    sized = papers.select("faiss_id", length.cast("long").alias("n_chars"), "loaded_at")
    items = Workspace(spark, "packing").write(latest(sized, ["faiss_id"]))
    return pack(items, "faiss_id", "n_chars", _capacities(spark, folder))


def p4_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill(p4_packed(spark, folder), _capacities(spark, folder))


QUERIES = {"p4_packed": p4_packed, "p4_fill": p4_fill}
ORACLE: dict[str, str] = {}
