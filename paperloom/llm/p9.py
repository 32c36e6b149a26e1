"""Queries of problem 9: personal information in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.p7 import documents_once
from paperloom.llm.pii import find_all, pseudonymise, redact

#: Key of the surrogates of the query; a deployment passes its own secret.
SECRET = "paperloom"


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_all(documents_once(spark, folder, "text"), "doc_id", "text").select("doc_id", "kind", "start_at")


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(documents_once(spark, folder, "text"), "doc_id", "text")


def p9_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymise(documents_once(spark, folder, "text"), "doc_id", "text", SECRET)


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted, "p9_surrogates": p9_surrogates}
ORACLE: dict[str, str] = {}
