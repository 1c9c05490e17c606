"""Queries of the schema-drift operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import schema_drift
from lectern.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes between each file and its predecessor."""
    found = schema_drift.changes(table(spark, sf, "run_records", "file_id", "stream_id", "file_seq", "payload"))
    return found.where("change <> 'moved'").select("file_id", "change", "old_field", "new_field").distinct()


def p2_changes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field change occurs, in how many files, with the mean edit cost of the files."""
    found = schema_drift.changes(table(spark, sf, "run_records", "file_id", "stream_id", "file_seq", "payload"))
    return found.groupBy("change", "old_field", "new_field").agg(
        F.countDistinct("file_id").alias("files"), F.round(F.avg("cost"), 4).alias("mean_cost")
    )


def p2_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All runs and results of all files in one consistent table."""
    records = table(spark, sf, "run_records", "record_id", "file_id", "stream_id", "file_seq", "payload")
    return schema_drift.unified(records, schema_drift.changes(records))


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of each file with their types."""
    prof = schema_drift.profiles(table(spark, sf, "run_records", "file_id", "stream_id", "file_seq", "payload"))
    return prof.select("file_id", F.explode("fields").alias("f")).select("file_id", "f.path", "f.kind").distinct()


QUERIES = {"p2_fields": p2_fields, "p2_found": p2_found, "p2_changes": p2_changes, "p2_unified": p2_unified}
ORACLE: dict[str, str] = {
    "p2_fields": (
        "WITH r AS (SELECT file_id, payload FROM run_records WHERE file_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),"
        " t AS (SELECT file_id, j.fullkey AS k, j.type AS t FROM r, json_tree(r.payload) j WHERE j.key IS NOT NULL AND j.type <> 'NULL' AND NOT j.fullkey LIKE '%]')"
        " SELECT DISTINCT file_id, substr(regexp_replace(replace(k, '\"', ''), '\\[\\d+\\]', '', 'g'), 3) AS path,"
        " CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM t"
    )
}
