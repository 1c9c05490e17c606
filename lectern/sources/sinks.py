"""Sinks: run records, run log, feedback, JSON lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def data_root(default: str = "data") -> str:
    """The data folder: LECTERN_DATA_DIR or the default."""
    return os.environ.get("LECTERN_DATA_DIR", default)


def write_run_records(runs: DataFrame, path: str) -> None:
    """Append {query, response} records, partitioned by a stable hash of the query (16 parts)."""
    runs.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(16))).write.mode("append").partitionBy("part").json(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log (run log or feedback)."""
    rows.write.mode("append").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON string per row; null fields are kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
