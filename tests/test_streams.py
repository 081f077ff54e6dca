"""Streaming jobs give what the batch operators give."""

import json
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators.audit import write_audit
from veilframe.operators.limits import Budget, limit_requests, window_starts
from veilframe.operators.sanitize import sanitize_text
from veilframe.operators.tools import audit_calls
from veilframe.plans import limits as PL
from veilframe.plans import tools as PT
from veilframe.sources import tables
from veilframe.sources.datasets import read_cases, read_snapshot
from veilframe.streaming import jobs, state


def run(spark, stream, tmp_path, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    return spark.table(name)


def test_masked_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"mail user{i}@example.com or 10.0.0.{i}") for i in range(20)], "id int, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(spark, jobs.masked_stream(stream, "text").select("id", "sanitized_text"), tmp_path, "masked")
    want = sanitize_text(df, "text").select("id", "sanitized_text")
    assert got.exceptAll(want).count() == 0 and got.count() == 20


def test_limiter_stream(spark, tmp_path):
    rows = [(i, "a", "p", i * 7_000_000, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, identity string, profile_id string, ts_us bigint, token_units int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.allowed, r.window_start) for r in run(spark, state.limited(stream, 4, 100), tmp_path, "limited").collect()}
    starts = {r.event_id: r.window_start for r in window_starts(df, 60_000_000).collect()}
    assert {k: v[1] for k, v in got.items()} == starts
    assert sum(a for a, _ in got.values()) == 4 * 3 + 3


def test_window_chain_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), "p", rng.randint(0, 4000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id bigint, identity string, profile_id string, ts_us bigint")
    got = {r.event_id: r.window_start for r in window_starts(df, 60, chunk_windows=2).collect()}
    for who in "ab":
        start = None
        for i, _, _, ts in sorted((r for r in rows if r[1] == who), key=lambda r: r[3]):
            start = ts if start is None or ts - start >= 60 else start
            assert got[i] == start


def test_event_assembly(spark, tmp_path):
    df = spark.createDataFrame([("s", 0, "data: a"), ("s", 1, "b\n"), ("s", 2, "\ndata: [DONE]\n\nrest")], "stream_id string, seq bigint, chunk string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert [r.event for r in run(spark, state.assembled(stream), tmp_path, "assembled").collect()] == ["data: ab", "data: [DONE]"]


class CountedState:
    """A value or a map kept in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattribute__(self, name):
        if name in ("get", "exists", "update", "iterator", "clear", "updateValue"):
            self.calls.append(name)
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def iterator(self):
        return iter(list(self.map.items()))

    def clear(self):
        self.map.clear()

    def updateValue(self, key, value):
        self.map[key] = value


def test_assembler_asks_the_state_only_for_what_waits():
    calls, made = [], state.EventAssembler(1 << 20, None)
    made.progress, made.waiting = CountedState(calls), CountedState(calls)

    def batch(*rows):
        calls.clear()
        parts = list(made.handleInputRows(("s",), iter([pd.DataFrame(rows, columns=["seq", "chunk"])]), None))
        return [tuple(r) for part in parts for r in part.itertuples(index=False)]

    assert batch((1, "b\n\n"), (0, "data: a")) == [("s", 0, "data: ab", "event")]
    assert calls == ["get", "update"]
    assert batch((3, "d\n\n"), (4, "e")) == [] and made.waiting.map == {(3,): ("d\n\n",), (4,): ("e",)}
    assert batch((2, "c")) == [("s", 1, "cd", "event")] and not made.waiting.map
    assert batch((5, "f\n\n")) == [("s", 2, "ef", "event")] and calls == ["get", "update"]


def test_streams_take_files_by_their_size(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(str(tmp_path / "t.parquet"))
    for size, batches in ((1 << 30, 1), (1, 8)):
        query = (tables.streamed(spark, str(tmp_path), "t", size=size).writeStream.format("noop")
                 .option("checkpointLocation", str(tmp_path / f"cp{size}")).trigger(availableNow=True).start())
        query.awaitTermination()
        assert query.lastProgress.batchId == batches - 1


def in_batches(spark, tmp_path, parts, schema):
    """A stream that reads each part in a micro-batch of its own, in this order."""
    for k, rows in enumerate(parts):
        part = str(tmp_path / f"part{k}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name, = [f for f in os.listdir(part) if f.endswith(".parquet")]
        os.makedirs(tmp_path / "in", exist_ok=True)
        os.rename(f"{part}/{name}", tmp_path / "in" / f"{k:03}.parquet")
        os.utime(tmp_path / "in" / f"{k:03}.parquet", (1_700_000_000 + 60 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


CHUNKS = "stream_id string, seq bigint, chunk string"


def test_chunks_out_of_order_across_batches(spark, tmp_path):
    body = "".join(f"data: event {k}\n\n" for k in range(40)) + "data: [DONE]\n\ndata: late\n\n"
    r = random.Random(3)
    cuts = sorted(r.sample(range(1, len(body)), 30))
    rows = [(s, k, body[a:b]) for s in "xy" for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(body)]))]
    r.shuffle(rows)
    stream = in_batches(spark, tmp_path, [rows[k::4] for k in range(4)], CHUNKS)
    got = run(spark, state.assembled(stream), tmp_path, "chunks").orderBy("stream_id", "pos").collect()
    events = [f"data: event {k}" for k in range(40)] + ["data: [DONE]"]
    assert [(g.stream_id, g.pos, g.event, g.status) for g in got] == [(s, k, e, "event") for s in "xy" for k, e in enumerate(events)]


def test_buffer_limit_and_idle_flush(spark, tmp_path):
    parts = [[("idle", 0, "data: a\n\ndata: half"), ("idle", 2, " rest\n\nmore"), ("big", 0, "x" * 60), ("null", 0, None)],
             [("big", 1, "y" * 60 + "\n\n")], [("big", 2, "z\n\n"), ("other", 0, "data: b\n\n")]]
    stream = in_batches(spark, tmp_path, parts, CHUNKS)
    out = state.assembled(stream, limit=50, idle_ms=1)
    query = (out.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(processingTime="100 milliseconds").start())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("flushed").filter("status = 'flushed'").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    got = sorted((g.stream_id, g.pos, g.event, g.status) for g in spark.table("flushed").collect())
    assert [g for g in got if g[0] == "idle"] == [("idle", 0, "data: a", "event"), ("idle", 1, "data: half rest", "flushed"), ("idle", 2, "more", "flushed")]
    assert [(g[1], g[3]) for g in got if g[0] == "big"][0] == (0, "over_limit")


def test_limiter_stream_equals_batch_by_profile(spark, tmp_path):
    r = random.Random(8)
    schema = "event_id bigint, identity string, profile_id string, ts_us bigint, token_units int"
    rows = sorted(((i, r.choice(["a", "b", None]), r.choice(["minimal", "strict", "custom", "unknown"]), r.randrange(10**9), r.choice([None, 0, 3, 30]))
                   for i in range(1200)), key=lambda x: x[3])
    parts = [rows[k:k + 200] for k in range(0, 1200, 200)]
    for part in parts:
        r.shuffle(part)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # a key's rows come in many Arrow batches
    try:
        budgets = {"minimal": Budget(6, 90), "strict": Budget(8, 90), "custom": Budget(5, 75, "dry_run")}
        stream = in_batches(spark, tmp_path, parts, schema)
        out = state.limited_by_profile(stream, budgets, "strict", 60_000_000)
        got = {g.event_id: tuple(g)[1:7] for g in run(spark, out, tmp_path, "by_profile").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    limits = spark.createDataFrame([("minimal", 4, 60, 1.5, "enforce"), ("strict", 8, 90, 1.0, "enforce"), ("custom", 3, 50, 1.5, "dry_run")], PL.SCHEMA)
    batch = limit_requests(spark.createDataFrame(rows, schema), limits, "strict")
    want = {w.event_id: tuple(w)[1:] for w in batch.select("event_id", "allowed", "reason", "retry_after_ms", "limit", "remaining", "reset_at_ms").collect()}
    assert len(want) == 1200 and got == want


def test_tool_audits_follow_changed_policies(spark, tmp_path):
    calls = PT.calls(spark, "/root/testdata/sf0.001").limit(300).collect()
    schema = PT.calls(spark, "/root/testdata/sf0.001").schema
    seen = []

    def policies(session):
        servers, tools = PT.policies(session)
        seen.append(1)
        return (servers.withColumn("enabled", F.lit(False)) if len(seen) == 2 else servers), tools

    stream = in_batches(spark, tmp_path, [calls[:100], calls[100:200], calls[200:]], schema)
    jobs.tool_audits(stream, policies, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    servers, tools = PT.policies(spark)
    want = audit_calls(spark.createDataFrame(calls[:100] + calls[200:], schema), servers, tools).unionByName(
        audit_calls(spark.createDataFrame(calls[100:200], schema), servers.withColumn("enabled", F.lit(False)), tools))
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    assert got.count() == 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and len(seen) == 3


def test_counters_and_first_requests(spark, tmp_path):
    rows = [(f"r{i % 40}", 1_700_000_000 + i, (200, 403, 500)[i % 3]) for i in range(120)]
    schema = "request_id string, at bigint, status int"
    stream = in_batches(spark, tmp_path, [rows[:50], rows[50:90], rows[90:]], schema).withColumn("ts", F.timestamp_seconds("at"))
    got = {(g.window_start.timestamp(), g.decision): g.value for g in jobs.run_totals(jobs.counters(stream), "counters").collect()}
    want = {}
    for _, at, status in rows:
        key = (at // 15 * 15, {200: "allowed", 403: "blocked", 500: "errored"}[status])
        want[key] = want.get(key, 0) + 1
    assert got == want
    first = jobs.run_available(jobs.first_requests(stream).select("request_id", "at"), "first")
    assert sorted((g.request_id, g["at"]) for g in first.collect()) == sorted((f"r{i}", 1_700_000_000 + i) for i in range(40))


def test_late_rows_are_not_counted(spark, tmp_path):
    schema = "at bigint, status int"
    stream = in_batches(spark, tmp_path, [[(1_700_000_000, 200)], [(1_700_010_000, 200)], [(1_700_010_001, 200)], [(1_700_000_001, 200)],
                                           [(1_700_020_000, 200)], [(1_700_030_000, 200)]], schema)
    out = run(spark, jobs.counters(stream.withColumn("ts", F.timestamp_seconds("at"))), tmp_path, "late").collect()
    assert {g.window_start.timestamp(): g.value for g in out} == {at // 15 * 15: n for at, n in (
        (1_700_000_000, 1), (1_700_010_000, 2), (1_700_020_000, 1))}


@pytest.mark.parametrize("null_key", ["identity", "profile_id"])
def test_limiter_keeps_null_keys(spark, null_key):
    df = spark.createDataFrame([(i, "a", "strict", i * 1_000_000, 1) for i in range(9)],
                               "event_id bigint, identity string, profile_id string, ts_us bigint, token_units int").withColumn(
        null_key, F.lit(None).cast("string"))
    limits = spark.createDataFrame([("strict", 4, 90, 1.0, "enforce")], PL.SCHEMA)
    got = limit_requests(df, limits, "strict").collect()
    assert len(got) == 9 and sum(g.allowed for g in got) == 4


def test_sources_and_audit_sink(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"case_id":"x","input":{"a":"b"},"tags":["t"]}\n\n', encoding="utf-8")
    row = read_cases(spark, str(tmp_path / "c.jsonl")).first()
    assert row.case_id == "x" and json.loads(row.input) == {"a": "b"}
    (tmp_path / "s.json").write_text(json.dumps({"source_id": "s", "rows": [{"row_idx": 3, "row": {"text": "t"}}]}, indent=1), encoding="utf-8")
    row = read_snapshot(spark, str(tmp_path / "s.json")).first()
    assert row.row_idx == 3 and json.loads(row.row) == {"text": "t"}
    write_audit(spark.range(3).withColumn("path_class", F.lit("direct")), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 3
