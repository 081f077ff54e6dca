"""Tool-call queries; every event becomes one call."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import sanitize as S
from veilframe.operators import tools as T
from veilframe.sources.tables import known_size, spread, table

QUERIES, ORACLES = {}, {}
SERVERS = [("click", True, ["t0", "t1", "t2"], ["t2"]), ("view", True, ["t0", "t1", "t3"], []), ("error", False, ["t0"], []),
           ("signup", True, ["t0", "t1", "t2", "t3"], [])]
SCHEMA = '{"type":"object","required":["k","path"],"properties":{"k":{"type":"integer"},"path":{"type":"string"},"note":{"type":"string"}},"additionalProperties":false}'
TOOLS = [("click", "t0", True, SCHEMA, True, 3, 20, ["k"], ["secret"], ["data/in", "tmp"]),
         ("view", "t1", False, None, None, None, None, [], [], []),
         ("signup", "t0", True, None, False, 2, 12, ["k", "note"], ["extra"], ["data"]),
         ("signup", "t1", True, None, None, None, None, [], [], [])]
TOOL_SCHEMA = ("server string, tool string, enabled boolean, schema string, output_sanitization boolean, max_depth int, "
               "max_string_length int, required array<string>, forbidden array<string>, path_prefixes array<string>")
PATHS = ("data/in/a.txt", "data/../secret", "/etc/passwd", "C:\\\\x", "tmp\\\\y/./z", "../up", "data/in/../in/b")


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def calls(spark, sf):
    return as_calls(spread(table(spark, sf, "events"), spark, "event_id"))


def as_calls(e):
    """Arguments vary with the event: missing keys, extra keys, long notes, bad paths, nesting."""
    i = F.col("event_id")
    path = F.element_at(F.array(*map(F.lit, PATHS)), F.expr(f"cast(event_id % {len(PATHS)} + 1 as int)"))
    args = F.concat(
        F.lit('{"k":'), F.when(i % 5 == 0, F.lit('"text"')).otherwise(F.get_json_object("props", "$.k")),
        F.when(i % 3 != 0, F.concat(F.lit(',"path":"'), path, F.lit('"'))).otherwise(""),
        F.when(i % 4 == 1, F.concat(F.lit(',"note":"'), F.col("event_type"), F.lit(' happened"'))).otherwise(""),
        F.when(i % 11 == 0, F.lit(',"extra":{"deep":[1]}')).otherwise(""), F.lit("}"))
    return e.select(
        i.cast("string").alias("request_id"), i.alias("event_id"), F.when(i % 50 == 0, F.lit(" ")).otherwise(F.col("event_type")).alias("server"),
        F.concat(F.lit("t"), (i % 4).cast("string")).alias("tool"), F.when(i % 37 == 0, F.lit("[1]")).otherwise(args).alias("arguments"),
        F.when(i % 7 == 0, F.create_map(F.lit("transport"), F.lit("grpc"))).when(
            i % 7 == 1, F.create_map(F.lit("variant"), F.lit("batch"), F.lit("transport"), F.lit("http_json"))).otherwise(
            F.create_map(F.lit("variant"), F.lit("tool_call"))).alias("tags"),
        F.when(i % 6 == 0, F.lit("custom")).when(i % 6 == 1, F.lit("strict")).alias("meta_profile"), F.lit("strict").alias("key_profile"))


CALLS = """SELECT event_id AS i, event_id::VARCHAR AS request_id, event_type, CASE WHEN event_id % 50 = 0 THEN ' ' ELSE event_type END AS server, 't' || (event_id % 4) AS tool,
  event_id % 37 = 0 AS not_object FROM events"""
REASON = """CASE WHEN server NOT IN ('click', 'view', 'signup') THEN 'server_not_allowlisted' WHEN server = 'click' AND tool = 't2' THEN 'tool_blocklisted'
  WHEN (server = 'click' AND tool = 't3') OR (server = 'view' AND tool = 't2') THEN 'tool_not_allowlisted' WHEN server = 'view' AND tool = 't1' THEN 'tool_blocklisted' ELSE 'allowed' END"""
SHAPE = "CASE WHEN server = ' ' THEN 'server_empty' WHEN not_object THEN 'arguments_not_object' END"
PILOT = "CASE i % 7 WHEN 0 THEN 'unsupported_transport' WHEN 1 THEN 'unsupported_variant' END"
REJECTED = "(server = ' ' OR not_object OR i % 7 IN (0, 1) OR i % 6 = 0)"
# which of the seven test paths each prefix list accepts
CLICK_BAD, SIGNUP_BAD = "i % 7 IN (1, 2, 3, 5)", "i % 7 IN (1, 2, 3, 4, 5)"
VIOL = f"""v AS (SELECT *, {REASON} AS reason,
  CASE WHEN server = 'click' AND tool = 't0' THEN (i % 3 = 0)::INT + (i % 5 = 0)::INT + (i % 11 = 0)::INT ELSE 0 END AS sv,
  CASE WHEN server = 'click' AND tool = 't0' THEN (i % 4 = 1 AND length(event_type) + 9 > 20)::INT + (i % 3 <> 0 AND {CLICK_BAD})::INT + (i % 11 = 0 AND false)::INT
       WHEN server = 'signup' AND tool = 't0' THEN (i % 4 <> 1)::INT + (i % 11 = 0)::INT * 2
         + (i % 3 <> 0 AND length([{', '.join("'" + p.replace(chr(92) * 2, chr(92)) + "'" for p in PATHS)}][(i % 7 + 1)::INT]) > 12)::INT
         + (i % 3 <> 0 AND {SIGNUP_BAD})::INT ELSE 0 END AS cv
  FROM c)"""


def policies(spark):
    return (known_size(spark, SERVERS, "id string, enabled boolean, allowed array<string>, blocked array<string>"),
            known_size(spark, TOOLS, TOOL_SCHEMA))


def checked(spark, sf):
    return T.argument_violations(T.call_reason(calls(spark, sf), *policies(spark)))


STAGE = "WHEN not_object THEN 'rejected'"


@add("t1_call_reasons", f"WITH c AS ({CALLS}) SELECT server, tool, {REASON} AS reason, count(*) AS calls FROM c GROUP BY ALL")
def call_reasons(spark, sf):
    """Allow and deny decisions in order of the checks."""
    return T.call_reason(calls(spark, sf), *policies(spark)).groupBy("server", "tool", "reason").agg(F.count("*").alias("calls"))


@add("t2_request_shape", f"WITH c AS ({CALLS}) SELECT request_id, {SHAPE} AS error FROM c WHERE {SHAPE} IS NOT NULL")
def request_shape(spark, sf):
    """Calls without server or tool, or whose arguments are no object."""
    return calls(spark, sf).select("request_id", T.shape_error(F.col("server"), F.col("tool"), F.col("arguments")).alias("error")).filter("error is not null")


@add("t3_pilot_subset", f"WITH c AS ({CALLS}) SELECT {PILOT} AS error, count(*) AS calls FROM c GROUP BY ALL")
def pilot_subset(spark, sf):
    """Transport and variant tags outside the supported subset."""
    return calls(spark, sf).groupBy(T.pilot_error(F.col("tags")).alias("error")).agg(F.count("*").alias("calls"))


@add("t4_profile_binding", "SELECT event_id::VARCHAR AS request_id FROM events WHERE event_id % 6 = 0")
def profile_binding(spark, sf):
    """Calls that ask for another profile than their key is bound to."""
    return calls(spark, sf).filter("meta_profile is not null and meta_profile <> key_profile").select("request_id")


def violation_query(column):
    def run(spark, sf):
        return checked(spark, sf).select(
            "request_id", F.col(column).isNull().alias("rejected"), F.coalesce(F.col(column), F.lit(0)).cast("bigint").alias("violations"))
    run.__doc__ = f"Number of {column.replace('_', ' ')} per call."
    return run


add("t5_schema_violations", f"WITH c AS ({CALLS}), {VIOL} SELECT request_id, not_object AS rejected, (CASE WHEN not_object THEN 0 ELSE sv END)::BIGINT AS violations FROM v")(violation_query("schema_violations"))
add("t6_constraint_violations", f"WITH c AS ({CALLS}), {VIOL} SELECT request_id, not_object AS rejected, (CASE WHEN not_object OR sv > 0 THEN 0 ELSE cv END)::BIGINT AS violations FROM v")(violation_query("constraint_violations"))


@add("t9_path_prefixes", f"""SELECT event_id, event_id % 7 IN (0, 4, 6) AS allowed, CASE event_id % 7 WHEN 0 THEN 'data|in|a.txt' WHEN 1 THEN 'secret' WHEN 4 THEN 'tmp|y|z' WHEN 6 THEN 'data|in|b' END AS segments FROM events""")
def path_prefixes(spark, sf):
    """Normalised path segments and the prefix decision."""
    plain = tuple(p.replace("\\\\", "\\") for p in PATHS)
    path = F.element_at(F.array(*map(F.lit, plain)), F.expr("cast(event_id % 7 + 1 as int)"))
    df = table(spark, sf, "events").select("event_id", path.alias("p"))
    return df.select("event_id", T.path_allowed(F.col("p"), F.array(F.lit("data/in"), F.lit("tmp"))).alias("allowed"),
                     F.array_join(T.path_segments(F.col("p")), "|").alias("segments"))


@add("t10_argument_checks", f"WITH c AS ({CALLS}), {VIOL} SELECT server, tool, CASE {STAGE} WHEN sv > 0 THEN 'schema' WHEN cv > 0 THEN 'constraints' ELSE 'valid' END AS stage, count(*) AS calls FROM v GROUP BY ALL")
def argument_checks(spark, sf):
    """Schema violations end the check before constraints."""
    stage = F.when(F.col("schema_violations").isNull(), "rejected").when(F.col("schema_violations") > 0, "schema").when(F.col("constraint_violations") > 0, "constraints").otherwise("valid")
    return checked(spark, sf).groupBy("server", "tool", stage.alias("stage")).agg(F.count("*").alias("calls"))


@add("t11_output_sanitization")
def output_sanitization(spark, sf):
    """Tool outputs (documents) masked where the tool's flag, else the default, says so."""
    docs = spread(table(spark, sf, "documents"), spark, "doc_id").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "signup").otherwise("click").alias("server"), F.lit("t0").alias("tool"))
    flagged = docs.join(policies(spark)[1].select("server", "tool", "output_sanitization"), ["server", "tool"], "left")
    out = S.sanitize_text(flagged, "text")
    on = F.coalesce("output_sanitization", F.lit(True))
    return out.select("doc_id", on.alias("sanitized_output"), F.when(on & F.col("blocked"), "output_blocked").otherwise("allowed").alias("reason"),
                      F.when(on & F.col("blocked"), F.greatest(F.size("hits"), F.lit(1))).when(on, F.size("hits")).otherwise(0).alias("hits"))


@add("t12_result_envelopes", """SELECT event_id, CASE event_id % 5 WHEN 2 THEN props WHEN 3 THEN NULL WHEN 4 THEN '"' || event_type || '"' ELSE event_type END AS content,
  CASE event_id % 5 WHEN 0 THEN 'text/plain' END AS content_type, event_id % 5 = 0 AND event_id % 2 = 0 AS truncated, CASE event_id % 5 WHEN 3 THEN 'result.content required' END AS error FROM events""")
def result_envelopes(spark, sf):
    """The content inside the kinds of result envelope, and an error where an envelope has none."""
    t, n = F.col("event_type"), F.col("event_id") % 5
    body = (F.when(n == 0, F.concat(F.lit('{"result":{"content":"'), t, F.lit('","content_type":"text/plain","truncated":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}}")))
            .when(n == 1, F.concat(F.lit('{"content":"'), t, F.lit('","content_type":7,"truncated":"yes"}'))).when(n == 2, F.col("props"))
            .when(n == 3, F.concat(F.lit('{"content":"outer","result":{"type":"'), t, F.lit('"}}'))).otherwise(F.concat(F.lit('"'), t, F.lit('"'))))
    return table(spark, sf, "events").select("event_id", T.result_envelope(body).alias("r")).select("event_id", "r.*")


@add("t13_call_audit", f"WITH c AS ({CALLS}), {VIOL} SELECT request_id, server AS server_id, tool AS tool_id, 'strict' AS profile_id, CASE WHEN {REJECTED} OR reason <> 'allowed' OR sv + cv > 0 THEN 'block' ELSE 'allow' END AS final_action, 0::BIGINT AS rule_hits_total, NOT ({REJECTED}) AND (reason <> 'allowed' OR sv + cv > 0) AS blocked FROM v")
def call_audit(spark, sf):
    """Audit record per call."""
    return T.audit_calls(calls(spark, sf), *policies(spark))
