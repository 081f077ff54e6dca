"""Structured Streaming jobs: the batch operators over streams, plus keyed state where needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from veilframe.operators.metrics import decision_of
from veilframe.operators.sanitize import sanitize_text
from veilframe.operators.tools import audit_calls
from veilframe.sources.tables import scratch


def masked_stream(stream: DataFrame, column: str, **options) -> DataFrame:
    """Continuous masking; stateless, so append output equals the batch result row by row."""
    return sanitize_text(stream, column, **options)


def counters(events: DataFrame, watermark: str = "5 minutes", width: str = "15 seconds") -> DataFrame:
    """Tumbling counters per decision; late rows beyond the watermark are not counted."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width).alias("w"), decision_of(F.col("status")).alias("decision"))
        .agg(F.count("*").alias("value"))
        .select(F.col("w.start").alias("window_start"), "decision", "value")
    )


def first_requests(stream: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Retried requests keep only their first copy."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])


def tool_audits(calls: DataFrame, policies: Callable[[SparkSession], tuple[DataFrame, DataFrame]], path: str) -> DataStreamWriter:
    """Audit records of a stream of tool calls, as Parquet with a folder per micro-batch.

    ``policies`` loads the server and tool tables anew for each micro-batch, so a change of policy holds
    from the next one on. A repeated micro-batch overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        audits = audit_calls(batch, *policies(batch.sparkSession))
        audits.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return calls.writeStream.foreachBatch(write)


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers and maps needs the store that spills to local disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_totals(stream: DataFrame, name: str) -> DataFrame:
    """The totals of an aggregation when a stream has been read as far as it goes; each micro-batch replaces the last."""
    path = scratch(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    query = stream.writeStream.foreachBatch(write).outputMode("complete")
    query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Everything that a stream can read now, written to the shared folder in micro-batches and read back."""
    path = scratch(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
