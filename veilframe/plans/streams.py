"""Stream jobs over the tables: each reads its files in micro-batches until all are read, and is checked like a batch query."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators.limits import Budget, effective_limit
from veilframe.plans import limits as PL
from veilframe.plans import metrics as PM
from veilframe.plans import tools as PT
from veilframe.plans.policy import ORACLES as POLICY_ORACLES
from veilframe.sources.tables import known_size, scratch, streamed
from veilframe.streaming import jobs, state

QUERIES, ORACLES = {}, {}


def add(name, oracle):
    def wrap(fn):
        QUERIES[name], ORACLES[name] = fn, oracle
        return fn
    return wrap


@add("st1_masked_stream", POLICY_ORACLES["sanitize_documents"])
def masked(spark, sf):
    """The masking job over a stream of documents."""
    out = jobs.masked_stream(streamed(spark, sf, "documents"), "text").select(
        "doc_id", "final_action", F.size("hits").cast("bigint").alias("hits_total"),
        F.md5("sanitized_text").alias("sanitized_md5"), F.col("transformed_fields").cast("bigint").alias("changed_fields"))
    return jobs.run_available(out, "masked")


@add("st2_decision_counters", f"WITH a AS ({PM.AUDIT}) SELECT epoch_us(date_trunc('day', ts)) AS window_start, {PM.DECISION} AS decision, count(*) AS value FROM a GROUP BY ALL")
def decision_counters(spark, sf):
    """Requests counted per day and decision; the totals so far after every micro-batch."""
    events = PM.audit_events(spark, sf, streamed).withColumn("ts", F.col("ts").cast("timestamp"))
    totals = jobs.counters(events, watermark="1 day", width="1 day")
    return jobs.run_totals(totals.withColumn("window_start", F.unix_micros("window_start")), "counters")


@add("st3_limiter_stream", PL.ORACLES["w1_limiter"])
def limiter_stream(spark, sf):
    """The limiter over a stream, with the budget of each profile."""
    jobs.use_state_store(spark)
    budgets = {r.profile_id: Budget(r.requests, r.tokens, r.mode) for r in known_size(spark, PL.LIMITS, PL.SCHEMA).select(
        "profile_id", "mode", effective_limit(F.col("requests_per_minute"), F.col("burst")).alias("requests"),
        effective_limit(F.col("token_units_per_minute"), F.col("burst")).alias("tokens")).collect()}
    requests = PL.as_requests(streamed(spark, sf, "events", files=1000))  # one micro-batch: files are not in time order
    out = state.limited_by_profile(requests, budgets, "strict", PL.WINDOW)
    return jobs.run_available(out.drop("window_start"), "limited")


@add("st4_event_assembly", """SELECT conv_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
  md5('data: ' || replace(text, chr(10), ' ')) AS event_md5, 'event' AS status FROM conversations""")
def event_assembly(spark, sf):
    """Events put together from chunks; each turn's text is one event that comes in two parts."""
    jobs.use_state_store(spark)
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    half = F.char_length("text") / 2
    parts = F.array(F.struct((2 * F.col("turn")).alias("seq"), F.concat(F.lit("data: "), F.substring(text, F.lit(1), half.cast("int"))).alias("chunk")),
                    F.struct((2 * F.col("turn") + 1).alias("seq"), F.concat(F.substring(text, half.cast("int") + 1, F.char_length("text")), F.lit("\n\n")).alias("chunk")))
    chunks = streamed(spark, sf, "conversations", size=256 << 20).select(F.col("conv_id").cast("string").alias("stream_id"), F.inline(parts))
    out = state.assembled(chunks)
    return jobs.run_available(out.select("stream_id", "pos", F.md5("event").alias("event_md5"), "status"), "assembled")


@add("st5_tool_compliance", PT.ORACLES["t13_call_audit"])
def tool_compliance(spark, sf):
    """Audit records of a stream of tool calls under policies that each micro-batch reads anew."""
    path = scratch(spark, "audits")
    writer = jobs.tool_audits(PT.as_calls(streamed(spark, sf, "events")), PT.policies, f"{path}/out")
    writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").drop("batch_id")


@add("st6_deduplicated_requests", "SELECT event_id::VARCHAR AS request_id FROM events")
def deduplicated(spark, sf):
    """Requests that a stream brings twice keep one copy."""
    jobs.use_state_store(spark)
    e = streamed(spark, sf, "events").select(F.col("event_id").cast("string").alias("request_id"), F.to_timestamp("ts").alias("ts"))
    return jobs.run_available(jobs.first_requests(e.unionByName(e), "3650 days").select("request_id"), "first")
