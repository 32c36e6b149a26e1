"""Run logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run string, seq long, t timestamp, kind string, n_returned int, prompt_tokens long, completion_tokens long"


def read_log(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The log lines of a folder as they arrive; broken lines are left out."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).option("mode", "DROPMALFORMED").json(folder)


def once(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run, seq) once, as long as its copies come no later than ``late``; state is bounded by that."""
    return log.withWatermark("t", late).dropDuplicatesWithinWatermark(["run", "seq"])


def totals(log: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """run, window, calls, searches, tokens per tumbling window; lines later than ``late`` no longer count."""
    w = F.window("t", window)
    return log.withWatermark("t", late).groupBy("run", w).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("kind") == "search").alias("searches"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens")
    )


def append(log: DataFrame, target: str, checkpoint: str):
    """Append the stream to a parquet table, exactly once, and stop when all that is there is read."""
    return log.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
