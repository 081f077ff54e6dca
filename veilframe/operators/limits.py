"""Keyed fixed-window rate limiting over event logs.

A window opens at a key's first request after the previous window ended, so windows form a chain
that depends on all earlier requests of the key. To keep one busy key from becoming one task the
chain is solved in parallel: each short time chunk of a key is summarised as a step function from
"when may a window open" to "last window opened", the small summaries are composed per key, and the
chunks then place their requests. Budgets are spent per single window.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["identity", "profile_id"]
DECISION = {"allowed": "boolean", "reason": "string", "retry_after_ms": "bigint", "limit": "bigint", "remaining": "bigint",
            "reset_at_ms": "bigint"}


def effective_limit(base: Column, burst: Column) -> Column:
    return F.greatest(F.lit(1), F.round(base * burst)).cast("bigint")


def _on_keys(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
    """Inner join on identity, profile (null equals null) and further columns; the right one's go."""
    right = right.select(*[F.col(c).alias(f"_{c}" if c in (*KEY, *more) else c) for c in right.columns])
    same = [left[c].eqNullSafe(right[f"_{c}"]) for c in KEY] + [left[c] == right[f"_{c}"] for c in more]
    return left.join(right, same).drop(*[f"_{c}" for c in (*KEY, *more)])


def window_starts(requests: DataFrame, window_us: int, chunk_windows: int = 5) -> DataFrame:
    """Adds ``window_start`` (microseconds) to requests with ``identity, profile_id, ts_us``."""
    chunk_us = window_us * chunk_windows
    chunked = requests.withColumn("chunk", F.floor(F.col("ts_us") / chunk_us).cast("bigint"))
    times = chunked.select(*KEY, "chunk", "ts_us").distinct()

    def openings(ts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The last window of the chunk for each index the first window may open at."""
        while True:
            nxt = np.searchsorted(ts, ts[at] + window_us)
            alive = nxt < len(ts)
            if not alive.any():
                return at
            at = np.where(alive, np.minimum(nxt, len(ts) - 1), at)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["ts_us"].to_numpy())
        first = int(np.searchsorted(ts, int(pdf["chunk"].iloc[0]) * chunk_us + window_us))
        starts = np.arange(min(first + 1, len(ts)))
        last = ts[openings(ts, starts)]
        keep = np.r_[last[1:] != last[:-1], True]  # equal neighbours merge into one step
        row = pdf.iloc[:1][[*KEY, "chunk"]].copy()
        row["until"], row["opens"] = [ts[starts][keep].tolist()], [last[keep].tolist()]
        return row

    summary = times.groupBy(*KEY, "chunk").applyInPandas(
        summarise, "identity string, profile_id string, chunk bigint, until array<bigint>, opens array<bigint>")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        free, out = -(2**62), []
        for chunk, until, opens in pdf.sort_values("chunk")[["chunk", "until", "opens"]].itertuples(index=False):
            out.append((chunk, free))
            i = int(np.searchsorted(until, free))
            if i < len(opens):
                free = int(opens[i]) + window_us
        res = pd.DataFrame(out, columns=["chunk", "free_from"])
        for k in KEY:
            res[k] = pdf[k].iloc[0]
        return res[[*KEY, "chunk", "free_from"]]

    entry = summary.groupBy(*KEY).applyInPandas(
        compose, "identity string, profile_id string, chunk bigint, free_from bigint")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(pdf["ts_us"].to_numpy())
        free = int(pdf["free_from"].iloc[0])
        start = np.full(len(ts), free - window_us)
        i = int(np.searchsorted(ts, free))
        while i < len(ts):
            j = int(np.searchsorted(ts, ts[i] + window_us))
            start[i:j] = ts[i]
            i = j
        out = pd.DataFrame({"ts_us": ts, "window_start": start})
        for k in (*KEY, "chunk"):
            out[k] = pdf[k].iloc[0]
        return out[[*KEY, "chunk", "ts_us", "window_start"]]

    placed = _on_keys(times, entry, "chunk").groupBy(*KEY, "chunk").applyInPandas(
        place, "identity string, profile_id string, chunk bigint, ts_us bigint, window_start bigint")
    return _on_keys(chunked, placed, "chunk", "ts_us").drop("chunk")


@dataclass(frozen=True)
class Budget:
    """What a profile may spend in a window; ``dry_run`` only reports."""

    requests: int
    tokens: int
    mode: str = "enforce"


def decide(budget: Budget | None, ts_us: int, want: int, start: int, used: int, tokens: int, window_us: int) -> tuple[tuple, tuple[int, int]]:
    """One decision (the columns of ``DECISION``) after ``used`` requests and ``tokens`` units, and what it spends."""
    wait = (start + window_us - ts_us) // 1000
    if budget is None:
        return (True, "within_budget", 0, 0, 0, ts_us // 1000), (0, 0)
    req_over, tok_over = used + 1 > budget.requests, want > max(budget.tokens - tokens, 0)
    over, dry = req_over or tok_over, budget.mode == "dry_run"
    reason = "request_budget_exhausted" if req_over else "token_budget_exhausted" if tok_over else "within_budget"
    row = (dry or not over, reason, max(wait, 1) if over else 0, budget.tokens if tok_over and not req_over else budget.requests,
           0 if over else budget.requests - used - 1, ts_us // 1000 + wait)
    return row, ((1, want) if dry or not over else (0, 0))


def spend(pdf: pd.DataFrame, window_us: int) -> pd.DataFrame:
    """Decisions of one window in time order; a rejected request spends nothing when enforcing."""
    used = tokens = 0
    rows = []
    for r in pdf.sort_values(["ts_us", "event_id"]).itertuples(index=False):
        row, spent = decide(Budget(r.request_limit, r.token_limit, r.mode), r.ts_us, r.token_units, r.window_start, used, tokens, window_us)
        used, tokens = used + spent[0], tokens + spent[1]
        rows.append((r.event_id, *row))
    return pd.DataFrame(rows, columns=["event_id", *DECISION])


def limit_requests(requests: DataFrame, limits: DataFrame, default_profile: str, window_us: int = 60_000_000) -> DataFrame:
    """One decision per request (``event_id, identity, profile_id, ts_us, token_units``).

    Unknown profiles use the default's budgets but keep their own windows; without any profile the
    request passes with limit 0.
    """
    names = ["requests_per_minute", "token_units_per_minute", "burst", "mode"]
    # one row at most, read as a scalar subquery: no join and no shuffle of the requests
    fallback = limits.filter(F.col("profile_id") == default_profile).agg(F.max(F.struct(*names))).scalar()
    full = requests.join(limits, "profile_id", "left").withColumn("_default", fallback).select(
        *requests.columns, *[F.coalesce(n, F.col("_default")[n]).alias(n) for n in names])
    ready = full.select(
        "event_id", *KEY, "ts_us", "mode", F.greatest(F.col("token_units"), F.lit(1)).cast("bigint").alias("token_units"),
        effective_limit(F.col("requests_per_minute"), F.col("burst")).alias("request_limit"),
        effective_limit(F.col("token_units_per_minute"), F.col("burst")).alias("token_limit"))
    placed = window_starts(ready.filter("mode is not null"), window_us)
    schema = "event_id bigint, " + ", ".join(f"{name} {kind}" for name, kind in DECISION.items())
    decided = placed.groupBy(*KEY, "window_start").applyInPandas(lambda pdf: spend(pdf, window_us), schema)
    free = ready.filter("mode is null").select(
        "event_id", F.lit(True).alias("allowed"), F.lit("within_budget").alias("reason"),
        F.lit(0).cast("bigint").alias("retry_after_ms"), F.lit(0).cast("bigint").alias("limit"),
        F.lit(0).cast("bigint").alias("remaining"), F.expr("ts_us div 1000").alias("reset_at_ms"))
    return decided.unionByName(free)
