"""Queries over audit events; the events table plays the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators import metrics as MT
from veilframe.plans import oracle as O
from veilframe.sources.tables import known_size, table

QUERIES, ORACLES = {}, {}
PATHS = ("/health", "/v1/sanitize/evaluate", "/v1/chat/completions", "/v1/models", "/v1/responses",
         "/v1/mcp/tool-call", "/v1/mcp/tools/search/invoke", "/favicon.ico")
STATUSES = (200, 201, 403, 404, 429, 500, 503, 302)
PROFILES = ("minimal", "strict", "custom", "other_profile")
ACTION_NAMES = ("allow", "mask", "replace", "redact", "block")


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def _pick(values, expr: str):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({expr} % {len(values)} + 1 as int)"))


def _list(values, expr: str) -> str:
    return "[" + ", ".join(O.q(v) if isinstance(v, str) else str(v) for v in values) + f"][({expr} % {len(values)} + 1)::INT]"


def audit_events(spark, sf, source=table) -> DataFrame:
    e = source(spark, sf, "events")
    return e.select(
        "event_id", "ts", "event_type", _pick(PATHS, "event_id").alias("path"),
        _pick(STATUSES, "(event_id div 3 + user_id)").alias("status"), _pick(PROFILES, "user_id").alias("profile"),
        _pick(ACTION_NAMES, "user_id div 7").alias("action"),
        F.expr("cast(round(value * 10) as bigint)").alias("duration_ms"), F.expr("event_id % 4").alias("rule_hits"))


AUDIT = f"""SELECT event_id, ts, event_type, {_list(PATHS, 'event_id')} AS path, {_list(STATUSES, '(event_id // 3 + user_id)')} AS status,
  {_list(PROFILES, 'user_id')} AS profile, {_list(ACTION_NAMES, 'user_id // 7')} AS action, round(value * 10)::BIGINT AS duration_ms, event_id % 4 AS rule_hits FROM events"""
ROUTE = f"""CASE WHEN starts_with(path, '/v1/mcp/tools/') AND ends_with(path, '/invoke') THEN '/v1/mcp/tools/{{toolName}}/invoke'
  WHEN path IN ({', '.join(O.q(r) for r in MT.ROUTES[:-1])}) THEN path ELSE 'other' END"""
PCLASS = """CASE WHEN path = '/v1/sanitize/evaluate' THEN 'sanitization' WHEN path IN ('/v1/chat/completions', '/v1/models', '/v1/responses') THEN 'llm'
  WHEN starts_with(path, '/v1/mcp') THEN 'mcp' ELSE 'runtime' END"""
DECISION = "CASE WHEN status BETWEEN 200 AND 299 THEN 'allowed' WHEN status IN (403, 429) THEN 'blocked' ELSE 'errored' END"
PROFILE = "CASE WHEN profile IN ('minimal', 'strict', 'custom') THEN profile ELSE 'custom' END"
ECLASS = "CASE WHEN status BETWEEN 400 AND 499 THEN 'upstream_4xx' WHEN status BETWEEN 500 AND 599 THEN 'upstream_5xx' ELSE 'transport' END"


def labels():
    path, status = F.col("path"), F.col("status")
    return {
        "route": MT.bounded(MT.normalize_route(path), "route"), "path_class": MT.bounded(MT.classify_path(path), "path_class"),
        "status": MT.status_class(status), "decision": MT.bounded(MT.decision_of(status), "decision")}


@add("a1_requests_total", f"WITH a AS ({AUDIT}) SELECT {ROUTE} AS route, {PCLASS} AS path_class, (status // 100)::VARCHAR || 'xx' AS status, {DECISION} AS decision, count(*) AS value FROM a GROUP BY ALL")
def requests_total(spark, sf):
    """Requests by route, path class, status class and decision."""
    return MT.counter(audit_events(spark, sf), **labels())


@add("a2_event_counters", f"""
  WITH a AS ({AUDIT}) SELECT 'blocked_total' AS series, {ROUTE} AS route, 'policy' AS kind, {PROFILE} AS profile, count(*) AS value FROM a WHERE status = 403 GROUP BY ALL
  UNION ALL SELECT 'rate_limit_events_total', {ROUTE}, CASE WHEN event_id % 2 = 0 THEN 'requests' ELSE 'token_units' END, {PROFILE}, count(*) FROM a WHERE status = 429 GROUP BY ALL
  UNION ALL SELECT 'upstream_errors_total', {ROUTE}, {ECLASS}, CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'other' END, count(*) FROM a WHERE status >= 400 GROUP BY ALL
  UNION ALL SELECT 'auth_decisions_total', CASE WHEN event_type = 'view' THEN 'static' ELSE 'unknown' END, 'gateway_auth', CASE WHEN status = 404 THEN 'fail' ELSE 'pass' END, count(*) FROM a GROUP BY ALL""")
def event_counters(spark, sf):
    """Blocked, rate-limit, upstream-error and auth counters in one scan."""
    a, lab = audit_events(spark, sf), labels()
    status, profile = F.col("status"), MT.bounded(F.col("profile"), "profile")
    kind = MT.bounded(F.when(F.col("event_id") % 2 == 0, "requests").otherwise("token_units"), "limit_kind")
    provider = MT.bounded(F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")), "provider")
    mode = MT.bounded(F.when(F.col("event_type") == "view", "static").otherwise("mesh"), "auth_mode")

    def row(series, when, one, two, three):
        return F.when(when, F.struct(F.lit(series).alias("series"), one.alias("route"), two.alias("kind"), three.alias("profile")))

    rows = F.array_compact(F.array(
        row("blocked_total", status == 403, lab["route"], MT.bounded(F.lit("policy"), "block_reason"), profile),
        row("rate_limit_events_total", status == 429, lab["route"], kind, profile),
        row("upstream_errors_total", status >= 400, lab["route"], MT.bounded(MT.upstream_error_class(status), "error_class"), provider),
        row("auth_decisions_total", F.lit(True), mode, MT.bounded(F.lit("gateway_auth"), "auth_stage"),
            MT.bounded(F.when(status == 404, "fail").otherwise("pass"), "auth_decision"))))
    return a.select(F.inline(rows)).groupBy("series", "route", "kind", "profile").agg(F.count("*").alias("value"))


@add("a3_bounded_labels", f"""
  WITH a AS ({AUDIT}) SELECT {PROFILE} AS profile, CASE WHEN action IN ('requests', 'token_units') THEN action ELSE 'requests' END AS limit_kind,
    CASE WHEN event_type IN ('static', 'passthrough') THEN event_type ELSE 'unknown' END AS auth_mode, 'errored' AS decision, count(*) AS value FROM a GROUP BY ALL""")
def bounded_labels(spark, sf):
    """Free-form label values folded into their vocabularies."""
    return MT.counter(audit_events(spark, sf), profile=MT.bounded(F.col("profile"), "profile"),
                      limit_kind=MT.bounded(F.col("action"), "limit_kind"), auth_mode=MT.bounded(F.col("event_type"), "auth_mode"),
                      decision=MT.bounded(F.col("event_type"), "decision"))


@add("a4_request_labels", f"WITH a AS ({AUDIT}) SELECT event_id, {ROUTE} AS route, {PCLASS} AS path_class, (status // 100)::VARCHAR || 'xx' AS status, {DECISION} AS decision FROM a")
def request_labels(spark, sf):
    """Route, path class, status class and decision per event."""
    return audit_events(spark, sf).select("event_id", *[c.alias(n) for n, c in labels().items()])


@add("a5_duration_histogram", f"""
  WITH a AS ({AUDIT}), les(le, bound) AS (VALUES {', '.join(f"('{b}', {b}::DOUBLE)" for b in MT.BUCKETS)}, ('+Inf', 'inf'::DOUBLE))
  SELECT {PCLASS} AS path_class, {DECISION} AS decision, le, count(*) FILTER (duration_ms / 1000.0 <= bound) AS bucket, round(sum(duration_ms / 1000.0), 6)::DOUBLE AS sum, count(*) AS count
  FROM a, les GROUP BY ALL""")
def duration_histogram(spark, sf):
    """Cumulative duration buckets per path class and decision."""
    lab = labels()
    h = MT.histogram(audit_events(spark, sf), F.col("duration_ms") / 1000.0, path_class=lab["path_class"], decision=lab["decision"])
    return h.withColumn("sum", F.round("sum", 6))


@add("a6_percentiles", f"""
  WITH a AS ({AUDIT}), r AS (SELECT event_type, duration_ms, row_number() OVER (PARTITION BY event_type ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a)
  SELECT event_type, min(duration_ms) FILTER (i = (n - 1) * 50 // 100) AS p50, min(duration_ms) FILTER (i = (n - 1) * 95 // 100) AS p95, min(duration_ms) FILTER (i = (n - 1) * 99 // 100) AS p99 FROM r GROUP BY ALL""")
def percentiles(spark, sf):
    """Exact nearest-rank percentiles of the duration."""
    return MT.nearest_rank(audit_events(spark, sf), "duration_ms", [50, 95, 99], "event_type")


@add("a7_rfc3339", """
  SELECT event_id, CASE WHEN event_id % 100 = 7 THEN 'invalid_unix_ms' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(ts) // 1000 % 1000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0'), '0') END || 'Z' END AS text FROM events""")
def rfc3339(spark, sf):
    """Event times in milliseconds as RFC 3339 text; out-of-range values are marked."""
    ms = F.when(F.col("event_id") % 100 == 7, F.lit(10**17)).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, sf, "events").select("event_id", MT.rfc3339_ms(ms).alias("text"))


@add("a8_plain_counters", f"""
  WITH a AS ({AUDIT}) SELECT sum(rule_hits)::BIGINT AS rule_hits_total, count(*) FILTER (action = 'block') AS blocked_total, count(*) FILTER (action = 'mask') AS action_mask_total,
    count(*) FILTER (action = 'redact') AS action_redact_total, count(*) FILTER (action = 'allow') AS action_allow_total, count(*) FILTER (action = 'replace') AS action_replace_total,
    count(*) FILTER (status BETWEEN 200 AND 299) AS upstream_2xx_total, count(*) FILTER (status BETWEEN 400 AND 499) AS upstream_4xx_total, count(*) FILTER (status BETWEEN 500 AND 599) AS upstream_5xx_total,
    sum(duration_ms)::BIGINT AS duration_ms_total, count(*) FILTER (starts_with(path, '/v1/mcp')) AS tool_calls_total FROM a""")
def plain_counters(spark, sf):
    """Unlabelled counters in a single aggregate."""
    s = F.col("status")
    return audit_events(spark, sf).agg(
        F.sum("rule_hits").alias("rule_hits_total"), F.count_if(F.col("action") == "block").alias("blocked_total"),
        *[F.count_if(F.col("action") == a).alias(f"action_{a}_total") for a in ("mask", "redact", "allow", "replace")],
        *[F.count_if(s.between(c * 100, c * 100 + 99)).alias(f"upstream_{c}xx_total") for c in (2, 4, 5)],
        F.sum("duration_ms").alias("duration_ms_total"),
        F.count_if(F.startswith("path", F.lit("/v1/mcp"))).alias("tool_calls_total"))


@add("a9_catalog_checks", f"""
  WITH a AS ({AUDIT}), s AS (SELECT event_type AS series, count(DISTINCT (profile, action, status)) AS label_sets FROM a GROUP BY ALL),
  r(series) AS (VALUES ('click'), ('view'), ('refund'), ('error')) SELECT coalesce(s.series, r.series) AS series, r.series IS NOT NULL AND s.series IS NULL AS missing, coalesce(label_sets, 0) > 25 AS too_many FROM s FULL JOIN r ON r.series = s.series""")
def catalog_checks(spark, sf):
    """Required series that are missing and series with too many label sets."""
    a = audit_events(spark, sf)
    present = a.select(F.col("event_type").alias("series"), "profile", "action", "status").distinct().groupBy("series").agg(
        F.count("*").alias("label_sets"))
    required = known_size(spark, [(s,) for s in ("click", "view", "refund", "error")], "series string")
    absent = MT.missing_series(present, required).select("series", F.lit(True).alias("missing"), F.lit(False).alias("too_many"))
    return present.select("series", F.lit(False).alias("missing"), (F.col("label_sets") > 25).alias("too_many")).unionByName(absent)


@add("a10_error_classes", f"WITH a AS ({AUDIT}) SELECT {ECLASS} AS error_class, count(*) AS value FROM a WHERE NOT status BETWEEN 200 AND 299 GROUP BY ALL")
def error_classes(spark, sf):
    """Upstream errors by class."""
    return MT.counter(audit_events(spark, sf).filter("not status between 200 and 299"), error_class=MT.upstream_error_class(F.col("status")))


@add("st2_windowed_counters", f"""WITH a AS ({AUDIT}) SELECT time_bucket(INTERVAL '15 seconds', ts) AS window_start, {DECISION} AS decision, count(*) AS value FROM a GROUP BY ALL""")
def windowed_counters(spark, sf):
    """Counters per 15-second window, as the streaming job keeps them."""
    from veilframe.streaming.jobs import counters

    return counters(audit_events(spark, sf)).select("window_start", "decision", "value")
