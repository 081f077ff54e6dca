"""Audit output and the check that it stays free of matched text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.arrays import explode_once, pinned
from veilframe.functions.leaves import typed_leaves


def leaked_values(evaluated: DataFrame, short: int = 4) -> DataFrame:
    """Matched values that occur in their own audit or explain record.

    ``evaluated`` is ``evaluate(..., trace=True)``. Values shorter than ``short`` occur in rule names by
    chance: they count where a whole text of the record equals them, longer ones anywhere in a text. The request id is not part of the search: callers choose it.
    """
    record = F.struct(F.col("audit").dropFields("request_id").alias("audit"), "explain")
    dtype = evaluated.select(record.alias("r")).schema["r"].dataType
    # each record is walked once, not once per hit, and hits stay in their row until few are left
    texts = F.array_distinct(F.transform(typed_leaves(record, dtype), lambda x: x["text"]))
    values = F.transform("hits", lambda h: F.substring(
        F.filter("leaves", lambda leaf: leaf["ptr"] == h["ptr"])[0]["text"], h["st"] + 1, h["en"] - h["st"]))
    leaks = F.filter("values", lambda v: F.exists("texts", lambda t: (t == v) | ((F.char_length(v) >= short) & F.contains(t, v))))
    rows = evaluated.select("request_id", pinned(values).alias("values"), pinned(texts).alias("texts"))
    return explode_once(rows.select("request_id", pinned(leaks).alias("leaks")), "leaks", "value", "request_id")


def write_audit(audit: DataFrame, path: str) -> None:
    """Append audit records as Parquet, one folder per path class."""
    audit.write.mode("append").partitionBy("path_class").parquet(path)
