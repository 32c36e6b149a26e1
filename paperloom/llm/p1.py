"""Queries of problem 1: papers and their listings elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import spread
from paperloom.llm.matching import match_records
from paperloom.sources.tables import latest, table

FIELDS = ["title", "doi", "authors", "date"]


def p1_matches(spark: SparkSession, folder: str) -> DataFrame:
    papers = spread(latest(table(spark, folder, "papers").select(F.col("faiss_id").alias("id"), *FIELDS, "loaded_at"), ["id"]), "id")
    listings = spread(latest(table(spark, folder, "papers_ext").select(F.col("ext_id").alias("id"), *FIELDS, "loaded_at"), ["id"]), "id")
    found = match_records(papers, listings)
    return found.select(F.col("paper").alias("faiss_id"), F.col("listing").alias("ext_id"), "confidence")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_matches(spark, folder).select("faiss_id", "ext_id")


QUERIES = {"p1_found": p1_found, "p1_matches": p1_matches}
ORACLE: dict[str, str] = {}
