"""Queries of problem 7: the corpus as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.common import spread
from paperloom.llm.tokenizer import encode_corpus
from paperloom.sources.tables import latest, table


def documents_once(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The documents, one row per doc_id, spread over all cores."""
    docs = table(spark, folder, "documents").select("doc_id", *columns, "loaded_at")
    return spread(latest(docs, ["doc_id"]).drop("loaded_at"), "doc_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(documents_once(spark, folder, "text"))


QUERIES = {"p7_ids": p7_ids}
ORACLE: dict[str, str] = {}
