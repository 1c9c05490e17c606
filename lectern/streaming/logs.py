"""The append-only logs as streams (an extension: nothing in the batch engine needs it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEEDBACK = "query string, paper_id string, relevant boolean, notes string, at timestamp"


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    """A feedback log as a stream without rows delivered twice within an hour."""
    rows = spark.readStream.schema(FEEDBACK).json(path)
    return rows.withWatermark("at", "1 hour").dropDuplicatesWithinWatermark(["query", "paper_id", "at"])


def votes_per_window(feedback: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Votes and relevant votes per paper and time window."""
    return feedback.groupBy(F.window("at", window), "paper_id").agg(F.count("*").alias("votes"), F.sum(F.col("relevant").cast("long")).alias("relevant"))
