"""Queries of problem 5: look-alike characters in papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.lookalikes import consistent, find_lookalikes, group_lookalikes
from paperloom.sources.tables import latest, table

FIELDS = ["title", "authors", "abs"]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_lookalikes(table(spark, folder, "papers"), "faiss_id", FIELDS)


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers").select("faiss_id", *FIELDS, "loaded_at")
    return latest(consistent(papers, FIELDS), ["faiss_id"]).drop("loaded_at")


def p5_title_groups(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "papers").select("faiss_id", "title", "loaded_at")
    return group_lookalikes(latest(papers, ["faiss_id"]), "faiss_id", "title")


QUERIES = {"p5_found": p5_found, "p5_consistent": p5_consistent, "p5_title_groups": p5_title_groups}
ORACLE: dict[str, str] = {}
