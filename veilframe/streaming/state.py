"""Keyed state: the rate limiter and the reassembly of event streams."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe.operators.limits import DECISION, Budget, decide

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT_OUT = "event_id bigint, allowed boolean, reason string, window_start bigint"
SSE_OUT = "stream_id string, pos bigint, event string, status string"
# Default stream buffer limit, the payload line that ends a stream.
MAX_BUFFER_BYTES = 1048576
LAST_EVENT = "data: [DONE]"


class FixedWindow(StatefulProcessor):
    """One window per identity and profile: start, requests, token units.

    All rows of a key in a micro-batch are put in time order first, however many Arrow batches they come
    in. A request that is older than the open window counts in it. State that is idle for ``ttl_ms``
    is dropped; an older window would be over anyway.
    """

    def __init__(self, budgets: Mapping[str, Budget], default: str | None, window_us: int, ttl_ms: int):
        self.budgets, self.default, self.window_us, self.ttl_ms = dict(budgets), default, window_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start bigint, requests bigint, tokens bigint", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, used, tokens = self.window.get() if self.window.exists() else (None, 0, 0)
        budget = self.budgets.get(key[1], self.budgets.get(self.default))
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts_us", "event_id"]).itertuples(index=False):
            if start is None or r.ts_us - start >= self.window_us:
                start, used, tokens = int(r.ts_us), 0, 0
            want = 1 if pd.isna(r.token_units) else max(int(r.token_units), 1)
            row, spent = decide(budget, int(r.ts_us), want, start, used, tokens, self.window_us)
            used, tokens = used + spent[0], tokens + spent[1]
            out.append((int(r.event_id), *row, start))
        self.window.update((start, used, tokens))
        yield pd.DataFrame(out, columns=["event_id", *DECISION, "window_start"])

    def close(self) -> None:
        pass


class EventAssembler(StatefulProcessor):
    """Joins the chunks of a stream by ``seq`` and gives out an event when an empty line completes it.

    Chunks that come before their turn wait in the state; each call to the state costs a round trip, so what
    waits is read and cleared only where something does. The stream ends with its last event, with more
    than ``limit`` bytes waiting (status ``over_limit``), or when nothing came for ``idle_ms``: then
    what is left goes out as it is (status ``flushed``). Chunks of an ended stream are left out.
    """

    def __init__(self, limit: int, idle_ms: int):
        self.limit, self.idle_ms = limit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next bigint, pos bigint, text string, ended boolean, timer bigint, held bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "chunk string")

    def _events(self, key, found: list[tuple[str, str]], pos: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], pos + k, event, status) for k, (event, status) in enumerate(found)],
                            columns=["stream_id", "pos", "event", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, pos, text, ended, timer, held = self.progress.get() or (0, 0, "", False, None, 0)
        chunks = {int(s): c or "" for pdf in rows for s, c in zip(pdf["seq"], pdf["chunk"]) if int(s) >= due}
        if held:
            chunks |= {k[0]: v[0] for k, v in self.waiting.iterator()}
            self.waiting.clear()
        found: list[tuple[str, str]] = []
        while due in chunks and not ended:
            text += chunks.pop(due)
            due += 1
            *events, text = text.split("\n\n")
            for event in events:
                if not ended and event.strip():
                    found.append((event, "event"))
                    ended = event.split("\n")[-1].strip() == LAST_EVENT
        if not ended and sum(len(c.encode()) for c in (text, *chunks.values())) > self.limit:
            found.append((None, "over_limit"))
            ended = True
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        chunks = {} if ended else chunks
        self.progress.update((due, pos + len(found), "" if ended else text, ended, timer, len(chunks)))
        for seq, chunk in chunks.items():
            self.waiting.updateValue((seq,), (chunk,))
        if found:
            yield self._events(key, found, pos)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, pos, text, ended, _, _ = self.progress.get()
        text += "".join(chunk for _, (chunk,) in sorted(self.waiting.iterator()))
        found = [(event, "flushed") for event in text.split("\n\n") if event.strip()] if not ended else []
        self.progress.clear()
        self.waiting.clear()
        yield self._events(key, found, pos)

    def close(self) -> None:
        pass


def limited(stream: DataFrame, request_limit: int, token_limit: int, window_us: int = 60_000_000, dry_run: bool = False) -> DataFrame:
    """Decisions for a stream of ``identity, profile_id, event_id, ts_us, token_units`` under one budget."""
    budget = Budget(request_limit, token_limit, "dry_run" if dry_run else "enforce")
    return limited_by_profile(stream, {"": budget}, "", window_us).select("event_id", "allowed", "reason", "window_start")


def limited_by_profile(stream: DataFrame, budgets: Mapping[str, Budget], default: str | None, window_us: int = 60_000_000,
                       ttl_ms: int | None = None) -> DataFrame:
    """The same under the budget of each profile: all columns of ``limits.limit_requests`` and the window's start.

    Unknown profiles use the default's budget but keep windows of their own; without any the request
    passes with limit 0. Jobs that go on give ``ttl_ms``, two windows or more; with it a query has always
    another micro-batch to run, so one that ends when its input does leaves it out.
    """
    processor = FixedWindow(budgets, default, window_us, ttl_ms)
    columns = ", ".join(f"{name} {kind}" for name, kind in DECISION.items())
    return stream.groupBy("identity", "profile_id").transformWithStateInPandas(
        processor, f"event_id bigint, {columns}, window_start bigint", "Append",
        "None" if ttl_ms is None else "ProcessingTime")


def assembled(chunks: DataFrame, limit: int = MAX_BUFFER_BYTES, idle_ms: int | None = None) -> DataFrame:
    """Complete events of a stream of ``stream_id, seq, chunk``; ``seq`` counts from 0 without gaps.

    Jobs that go on give ``idle_ms``; as with the limiter, one that ends when its input does leaves it out.
    """
    return chunks.groupBy("stream_id").transformWithStateInPandas(
        EventAssembler(limit, idle_ms), SSE_OUT, "Append", "None" if idle_ms is None else "ProcessingTime")
