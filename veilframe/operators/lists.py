"""Allow and deny lists that live in tables.

Both are equi-joins on the compared value. The list side is reduced to distinct values first; Spark
broadcasts it when its measured size allows and otherwise shuffles, with AQE splitting hot values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.match import exact_key_sql


def denylist_hits(leaves: DataFrame, denylist: DataFrame, text: str = "text") -> DataFrame:
    """Whole-leaf, case-sensitive matches; ``denylist`` has ``rule_id`` and ``value``."""
    listed = denylist.select(F.col("value").alias(text), "rule_id")
    return leaves.join(listed, text).withColumn("st", F.lit(0)).withColumn("en", F.char_length(text))


def without_allowlisted(candidates: DataFrame, value: str, allowlist: DataFrame) -> DataFrame:
    """Candidates whose folded text is not in ``allowlist.value``."""
    allowed = allowlist.select(F.expr(exact_key_sql("value")).alias("_key")).distinct()
    return candidates.withColumn("_key", F.expr(exact_key_sql(value))).join(allowed, "_key", "left_anti").drop("_key")
