"""Queries of problem 8: documents mixed to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.mixing import Target, mix, shares
from paperloom.llm.p7 import documents_once
from paperloom.llm.tokenizer import encode_corpus
from paperloom.sources.tables import table


def _targets(spark: SparkSession, folder: str) -> list[Target]:
    """The targets; mix_targets is a table of a few rows that does not grow."""
    rows = table(spark, folder, "mix_targets").where("source is not null").collect()
    return [Target(r["source"].strip().lower(), r["target_share"] or 0.0, r["max_repeats"] or 0) for r in rows]


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents_once(spark, folder, "source", "text").withColumn("source", F.lower(F.trim("source")))
    sized = encode_corpus(docs, out="n_tokens", counts_only=True)
    return mix(sized, "doc_id", "source", "n_tokens", _targets(spark, folder))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p8_mix(spark, folder), _targets(spark, folder))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLE: dict[str, str] = {}
