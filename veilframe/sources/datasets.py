"""Evaluation inputs: case files, dataset snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = (
    "case_id string, language string, mode string, input string, expected_entities array<string>, "
    "expected_operator_outcome string, expected_policy_outcome string, tags array<string>, source string, notes string"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One case per line; blank lines are skipped and ``input`` stays JSON text."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", CASE_SCHEMA).alias("c")).select("c.*")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of snapshot documents ``{source_id, rows: [{row_idx, row}]}``; ``row`` stays JSON text."""
    schema = "source_id string, rows array<string>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = docs.select("source_id", F.explode("rows").alias("entry"))
    return rows.select("source_id", F.get_json_object("entry", "$.row_idx").cast("bigint").alias("row_idx"),
                       F.coalesce(F.get_json_object("entry", "$.row"), F.col("entry")).alias("row"))
