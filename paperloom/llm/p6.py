"""Queries of problem 6: model calls with an unusable answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.pairs import label_pairs, main_defect
from paperloom.sources.tables import table


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    return label_pairs(table(spark, folder, "draws"), "draw_id", "prompt", "completion", "finish_reason", "error", "loaded_at")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_defect(p6_labels(spark, folder), "draw_id")


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels}
ORACLE: dict[str, str] = {}
