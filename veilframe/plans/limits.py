"""Rate-limit queries; event users are the identities, values the token units.

Thirty days of events are replayed 720 times faster, so that windows fill up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import limits as L
from veilframe.sources.tables import known_size, table

QUERIES, ORACLES = {}, {}
START_US = 1704067200000000
WINDOW = 60_000_000
LIMITS = [("minimal", 4, 60, 1.5, "enforce"), ("strict", 8, 90, 1.0, "enforce"), ("custom", 3, 50, 1.5, "dry_run")]
SCHEMA = "profile_id string, requests_per_minute int, token_units_per_minute int, burst double, mode string"


def as_requests(events):
    profile = F.element_at(F.array(*map(F.lit, ("minimal", "strict", "custom", "unknown"))), F.expr("cast(user_id % 4 + 1 as int)"))
    return events.select(
        "event_id", F.concat(F.lit("user-"), (F.col("user_id") % 20).cast("string")).alias("identity"),
        profile.alias("profile_id"),
        F.expr(f"{START_US} + (unix_micros(cast(ts as timestamp)) - {START_US}) div 720").alias("ts_us"),
        F.floor("value").cast("int").alias("token_units"))


def limit_requests_input(spark, sf):
    return as_requests(table(spark, sf, "events"))


W_SQL = f"""
  WITH RECURSIVE lim(profile_id, rpm, tpm, burst, mode) AS (VALUES {', '.join(f"('{p}', {r}, {t}, {b}::DOUBLE, '{m}')" for p, r, t, b, m in LIMITS)}),
  req AS (SELECT event_id, 'user-' || (user_id % 20) AS identity, ['minimal', 'strict', 'custom', 'unknown'][(user_id % 4 + 1)::INT] AS profile_id,
    {START_US} + (epoch_us(ts) - {START_US}) // 720 AS ts, greatest(floor(value), 1)::BIGINT AS tok FROM events),
  r AS (SELECT req.*, greatest(1, round(l.rpm * l.burst))::BIGINT AS rl, greatest(1, round(l.tpm * l.burst))::BIGINT AS tl, l.mode,
    row_number() OVER (PARTITION BY identity, req.profile_id ORDER BY ts, event_id) AS n FROM req
    JOIN lim l ON l.profile_id = CASE WHEN req.profile_id = 'unknown' THEN 'strict' ELSE req.profile_id END),
  s AS (SELECT r.*, ts AS ws, 0::BIGINT AS ur, 0::BIGINT AS ut FROM r WHERE n = 1
    UNION ALL SELECT r.event_id, r.identity, r.profile_id, r.ts, r.tok, r.rl, r.tl, r.mode, r.n,
      CASE WHEN r.ts - s.ws >= {WINDOW} THEN r.ts ELSE s.ws END,
      CASE WHEN r.ts - s.ws >= {WINDOW} THEN 0 ELSE s.ur + CASE WHEN s.mode = 'dry_run' OR (s.ur + 1 <= s.rl AND s.ut + s.tok <= s.tl) THEN 1 ELSE 0 END END,
      CASE WHEN r.ts - s.ws >= {WINDOW} THEN 0 ELSE s.ut + CASE WHEN s.mode = 'dry_run' OR (s.ur + 1 <= s.rl AND s.ut + s.tok <= s.tl) THEN s.tok ELSE 0 END END
    FROM s JOIN r ON r.identity = s.identity AND r.profile_id = s.profile_id AND r.n = s.n + 1),
  d AS (SELECT *, ur + 1 > rl AS ro, tok > greatest(tl - ut, 0) AS too, (ws + {WINDOW} - ts) // 1000 AS wait FROM s)
"""
DECIDED = """SELECT event_id, mode = 'dry_run' OR NOT (ro OR too) AS allowed, CASE WHEN ro THEN 'request_budget_exhausted' WHEN too THEN 'token_budget_exhausted' ELSE 'within_budget' END AS reason,
  CASE WHEN ro OR too THEN greatest(wait, 1) ELSE 0 END::BIGINT AS retry_after_ms, CASE WHEN too AND NOT ro THEN tl ELSE rl END AS "limit",
  CASE WHEN ro OR too THEN 0 ELSE rl - ur - 1 END::BIGINT AS remaining, (ts // 1000 + wait)::BIGINT AS reset_at_ms FROM d"""


def limiter(spark, sf):
    """A decision per request: reason, remaining budget, retry delay and reset time."""
    return L.limit_requests(limit_requests_input(spark, sf), known_size(spark, LIMITS, SCHEMA), "strict", WINDOW)


def modes(spark, sf):
    """Reasons per enforcement: dry run always allows."""
    return limiter(spark, sf).groupBy("allowed", "reason").agg(F.count("*").alias("requests"))


def starts(spark, sf):
    """The window each request falls in."""
    return L.window_starts(limit_requests_input(spark, sf), WINDOW).select("event_id", "window_start")


def limits_table(spark, sf):
    """Effective limits per profile, the default's for unknown ones, with the requests they govern."""
    lim = known_size(spark, LIMITS, SCHEMA).select(
        "profile_id", L.effective_limit(F.col("requests_per_minute"), F.col("burst")).alias("request_limit"),
        L.effective_limit(F.col("token_units_per_minute"), F.col("burst")).alias("token_limit"))
    default = lim.filter("profile_id = 'strict'").agg(F.max(F.struct("request_limit", "token_limit"))).scalar()
    asked = limit_requests_input(spark, sf).groupBy("profile_id").agg(F.count("*").alias("requests"))
    return asked.join(lim, "profile_id", "left").select("profile_id", "requests", *[
        F.coalesce(c, default[c]).alias(c) for c in ("request_limit", "token_limit")])


def fallback(spark, sf):
    """Requests of unknown profiles under the default's budgets, in windows of their own."""
    req = limit_requests_input(spark, sf).filter("profile_id = 'unknown'").select("event_id")
    return limiter(spark, sf).join(req, "event_id", "left_semi").select("event_id", "allowed", "limit")


QUERIES.update(w1_limiter=limiter, w1_window_starts=starts, w2_enforcement_modes=modes, w3_effective_limits=limits_table,
               w5_profile_fallback=fallback)
ORACLES.update(
    w1_limiter=W_SQL + DECIDED,
    w1_window_starts=W_SQL + "SELECT event_id, ws AS window_start FROM d",
    w2_enforcement_modes=W_SQL + f"SELECT allowed, reason, count(*) AS requests FROM ({DECIDED}) GROUP BY ALL",
    w3_effective_limits=W_SQL + "SELECT profile_id, rl AS request_limit, tl AS token_limit, count(*) AS requests FROM r GROUP BY ALL",
    w5_profile_fallback=W_SQL + f"SELECT event_id, allowed, \"limit\" FROM ({DECIDED}) JOIN d USING (event_id) WHERE profile_id = 'unknown'",
)
