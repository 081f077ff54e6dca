"""Chat queries; conversation turns become requests, replies and stream chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import chat as C
from veilframe.plans import oracle as O
from veilframe.sources.tables import known_size, table

QUERIES, ORACLES = {}, {}
ROUTES = [("GPT-Main", "p1", ["main", " Fast "], True, True), ("other", "p2", ["alt"], True, True), ("old", "p1", [], False, False), ("Dup", "p1", ["ALT"], None, True)]
PROVIDERS = [("p1", "strict", True), ("p2", "custom", True), ("p3", None, False)]
MODELS = ("gpt-main", " FAST", "main", "Other", "old", "nothing")
ASKED = (" ALT", "other")


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def pick(values, expr):
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({expr} % {len(values)} + 1 as int)"))


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        F.expr("concat_ws('-', cast(conv_id as string), cast(turn as string))").alias("request_id"), "*",
        F.expr("conv_id * 7 + turn").alias("n"))


T = "t AS (SELECT conv_id || '-' || turn AS request_id, *, conv_id * 7 + turn AS n FROM conversations)"


@add("l1_chat_validation", f"""WITH {T} SELECT request_id, CASE n % 8 WHEN 0 THEN 'body not an object' WHEN 1 THEN 'model required' WHEN 2 THEN 'messages required' WHEN 3 THEN 'messages empty'
  WHEN 4 THEN 'messages[1].role unknown' WHEN 5 THEN 'messages[0].content required' WHEN 6 THEN 'messages[1].content block invalid' END AS error FROM t""")
def chat_validation(spark, sf):
    """First error of each chat body, null for well-formed ones."""
    n, ok = F.col("n") % 8, F.to_json(F.struct("role", F.col("text").alias("content")))
    def body(*msgs):
        return F.concat(F.lit('{"model":"m","messages":['), *[x for i, m in enumerate(msgs) for x in ([F.lit(",")] if i else []) + [m]], F.lit("]}"))
    built = (F.when(n == 0, F.lit("[1]")).when(n == 1, F.lit('{"model":" ","messages":[]}')).when(n == 2, F.lit('{"model":"m"}')).when(n == 3, body())
             .when(n == 4, body(ok, F.lit('{"role":"robot","content":"x"}'))).when(n == 5, body(F.lit('{"role":"user"}')))
             .when(n == 6, body(ok, F.lit('{"role":"user","content":[{"text":"x"}]}'))).otherwise(body(ok, F.lit('{"role":"tool","content":[{"type":"text","text":"x"}]}'))))
    return C.validate(turns(spark, sf).withColumn("body", built), "body").select("request_id", "error")


@add("l2_responses_input", f"""WITH {T} SELECT request_id, i AS pos, CASE n % 8 WHEN 3 THEN 'input empty' WHEN 4 THEN 'input[1] unsupported' WHEN 5 THEN 'input.content unsupported' WHEN 6 THEN 'input[0].role required' END AS error,
    CASE WHEN n % 8 IN (3, 4, 5, 6) THEN NULL WHEN n % 8 IN (1, 7) OR (n % 8 = 2 AND i = 1) THEN role ELSE 'user' END AS role,
    CASE WHEN n % 8 IN (0, 1, 2) THEN md5(text) END AS content_md5,
    CASE WHEN n % 8 = 7 THEN md5('[{{"text":' || to_json(text)::VARCHAR || ',"type":"input_text"}}]') END AS blocks_md5
  FROM t, range(2) r(i) WHERE i = 0 OR n % 8 = 2""")
def responses_input(spark, sf):
    """Responses input as text, object, list or blocks, mapped to messages; errors for what is not supported."""
    quoted = F.expr("substring(to_json(array(text)), 2, char_length(to_json(array(text))) - 2)")
    msg = F.to_json(F.struct("role", F.col("text").alias("content")))
    n = F.col("n") % 8
    value = (F.when(n == 0, quoted).when(n == 1, msg).when(n == 2, F.concat(F.lit("["), quoted, F.lit(","), msg, F.lit("]")))
             .when(n == 3, F.lit("[]")).when(n == 4, F.concat(F.lit("["), msg, F.lit(",7]"))).when(n == 5, F.lit('{"role":"user","content":7}'))
             .when(n == 6, F.concat(F.lit('[{"role":" ","content":'), quoted, F.lit("}]")))
             .otherwise(F.to_json(F.struct("role", F.array(F.struct("text", F.lit("input_text").alias("type"))).alias("content")))))
    df = turns(spark, sf).withColumn("body", F.concat(F.lit('{"model":"m","input":'), value, F.lit("}")))
    m = C.responses_input(df, "body").select("request_id", "error", F.posexplode_outer("messages").alias("pos", "m"))
    return m.select("request_id", F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"), "error", "m.role", F.md5("m.content").alias("content_md5"),
                    F.md5("m.blocks").alias("blocks_md5"))


@add("l3_metadata_tags", f"WITH {T} SELECT request_id, k AS tag, CASE k WHEN 'profile' THEN 'strict' ELSE role END AS value FROM t, (VALUES ('profile'), ('role')) v(k)")
def metadata_tags(spark, sf):
    """String metadata entries."""
    body = F.to_json(F.struct(F.struct(F.lit("strict").alias("profile"), F.col("role"), F.col("turn"), F.array("role").alias("list")).alias("metadata")))
    return turns(spark, sf).select("request_id", F.explode(C.metadata_tags(body)).alias("tag", "value"))


@add("l4_effective_profile", f"""WITH {T} SELECT request_id, CASE n % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN CASE n % 2 WHEN 1 THEN 'custom' ELSE 'strict' END WHEN 2 THEN 'strict' ELSE 'custom' END AS profile FROM t""")
def effective_profile(spark, sf):
    """Known hint, else provider, else key, else default."""
    hint = F.when(F.col("n") % 4 == 0, F.lit(" minimal ")).when(F.col("n") % 4 == 1, F.lit("nope"))
    provider = F.when(F.col("n") % 2 == 1, F.lit("custom")).otherwise(F.lit("gone"))
    return turns(spark, sf).select("request_id", C.effective_profile(hint, provider, F.lit("strict"), F.lit("strict")).alias("profile"))


@add("l5_model_keys", "SELECT DISTINCT lower(trim(c_mktsegment)) AS key, c_mktsegment AS model FROM customer")
def model_keys(spark, sf):
    """Normalised model keys (market segments stand in for model names)."""
    return table(spark, sf, "customer").select(C.model_key(F.concat(F.lit(" "), "c_mktsegment")).alias("key"), F.col("c_mktsegment").alias("model")).distinct()


def keys(spark, routes=ROUTES[:3]):
    r = known_size(spark, routes, "model string, provider_id string, aliases array<string>, output_sanitization boolean, enabled boolean")
    return C.route_keys(r, known_size(spark, PROVIDERS, "id string, profile_id string, enabled boolean"))


@add("l6_model_routing", f"""WITH {T} SELECT request_id, ['GPT-Main', 'GPT-Main', 'GPT-Main', 'other', NULL, NULL][(n % 6 + 1)::INT] AS canonical_model, [false, true, true, false, NULL, NULL][(n % 6 + 1)::INT] AS via_alias,
  CASE WHEN n % 6 >= 4 THEN 'model_not_routed' END AS error FROM t""")
def model_routing(spark, sf):
    """Requests routed by canonical name or alias."""
    return C.route(turns(spark, sf).withColumn("model", pick(MODELS, "n")), keys(spark)).select("request_id", "canonical_model", "via_alias", "error")


@add("l7_alias_conflicts", f"WITH {T} SELECT 'alt' AS key, 2::BIGINT AS routes, (SELECT count(*) FROM t WHERE n % 2 = 0) AS requests")
def alias_conflicts(spark, sf):
    """Keys claimed by more than one route, with the requests that use them."""
    asked = turns(spark, sf).groupBy(C.model_key(pick(ASKED, "n")).alias("key")).agg(F.count("*").alias("requests"))
    return C.key_conflicts(keys(spark, ROUTES)).join(asked, "key")


@add("l9_identities", f"""WITH {T} SELECT request_id, CASE n % 3 WHEN 0 THEN 'client-' || role WHEN 1 THEN 'ingress' ELSE 'gw' END AS identity, CASE WHEN n % 3 = 0 AND role = 'user' THEN 'minimal' WHEN n % 2 = 0 THEN 'custom' ELSE 'strict' END AS profile FROM t""")
def identities(spark, sf):
    """Identity by source order, profile by binding, key, fallback."""
    n = F.col("n")
    df = turns(spark, sf).select("request_id", F.coalesce(
        F.when(n % 3 == 0, F.concat(F.lit("client-"), "role")), F.when(n % 3 != 2, F.lit("ingress")), F.lit("gw")).alias("identity"),
        F.when(n % 2 == 0, F.lit("custom")).alias("key_profile"))
    bound = known_size(spark, [("client-user", "minimal")], "identity string, bound string")
    return df.join(bound, "identity", "left").select("request_id", "identity", F.coalesce("bound", "key_profile", F.lit("strict")).alias("profile"))


@add("l10_fingerprints", "SELECT c_custkey, 'gw_' || substring(sha256(c_name), 1, 32) AS subject FROM customer")
def fingerprints(spark, sf):
    """Subject fingerprints of gateway tokens."""
    return table(spark, sf, "customer").select("c_custkey", C.fingerprint(F.col("c_name")).alias("subject"))


def sse_bodies(spark, sf):
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta")), F.struct(F.struct(F.lit("!").alias("content")).alias("delta"))).alias("choices")))
    return turns(spark, sf).select("request_id", "text", F.concat(F.lit("event: delta\ndata: "), delta, F.lit("\n\ndata: not json\n\n\n\ndata: [DONE]\n\n")).alias("body"))


@add("l11_sse_lines", f"WITH {T} SELECT kind, count(*) * m AS lines FROM t, (VALUES ('other', 1), ('json', 1), ('not_json', 1), ('done', 1)) v(kind, m) GROUP BY kind, m")
def sse_lines(spark, sf):
    """Event-stream bodies split into classified lines."""
    return C.sse_lines(sse_bodies(spark, sf), "body").groupBy("kind").agg(F.count("*").alias("lines"))


@add("l13_text_deltas", f"WITH {T} SELECT request_id, md5(text || '!') AS delta_md5 FROM t")
def text_deltas(spark, sf):
    """Joined text deltas of all choices."""
    return C.sse_lines(sse_bodies(spark, sf), "body").filter("kind = 'json'").select("request_id", F.md5(C.text_delta(F.col("data"))).alias("delta_md5"))


@add("l16_buffer_limits", "SELECT conv_id::VARCHAR AS stream_id, sum(octet_length(encode(text)))::BIGINT AS bytes FROM conversations GROUP BY conv_id HAVING bytes > 1000")
def buffer_limits(spark, sf):
    """Streams larger than the buffer."""
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("text").alias("chunk"))
    return C.over_limit(chunks, 1000)


@add("l18_request_outcomes", f"""WITH {T} SELECT request_id, CASE WHEN n % 5 = 0 THEN 'block' WHEN n % 3 = 0 THEN 'redact' ELSE 'allow' END AS final_action, (n % 4 + 1)::BIGINT AS hits FROM t""")
def request_outcomes(spark, sf):
    """Input and output decisions combined."""
    n = F.col("n")
    i = turns(spark, sf).select("request_id", F.when(n % 3 == 0, "redact").otherwise("allow").alias("final_action"), F.when(n % 3 == 0, 3).otherwise(0).alias("rank"), (n % 4).alias("hits"))
    o = turns(spark, sf).select("request_id", F.when(n % 5 == 0, "block").otherwise("allow").alias("final_action"), F.when(n % 5 == 0, 4).otherwise(0).alias("rank"), F.lit(1).cast("bigint").alias("hits"))
    return C.outcome(i, o)


@add("l19_error_digests", f"""WITH {T} SELECT request_id, 'bad_request' AS error_type, turn::VARCHAR AS error_code, NULL::VARCHAR AS error_param, octet_length(encode(text))::BIGINT AS message_bytes, 'code,message,type' AS keys FROM t""")
def error_digests(spark, sf):
    """Upstream errors described without their message."""
    body = F.to_json(F.struct(F.struct(F.lit("bad_request").alias("type"), F.col("turn").alias("code"), F.col("text").alias("message")).alias("error")))
    return turns(spark, sf).select("request_id", C.error_digest(body).alias("d")).select("request_id", "d.*")


TOLD = "text || ' write to bob' || n || '@example.com or 10.0.0.' || n % 250"


@add("l12_stream_outcomes", f"""
  WITH {T}, {O.hits_ctes(f"SELECT request_id AS k, v.leaf_seq, v.ptr, v.text FROM (SELECT *, {TOLD} AS told FROM t) t, LATERAL (VALUES (0, '/0/1/choices/0/delta/content', told), (1, '/2/0/note', role)) v(leaf_seq, ptr, text)")},
  {O.SPANS}, {O.FINAL}, {O.rewritten_ctes(4)}, h AS (SELECT k, count(*) AS found FROM hits GROUP BY k)
  SELECT t.request_id, coalesce(h.found, 0)::BIGINT AS hits, coalesce(f.final_action, 'allow') AS final_action,
    CASE WHEN coalesce(f.final_action, '') <> 'block' THEN md5('event: delta' || chr(10) || 'data: {{"choices": [{{"delta":{{"content":' || to_json(coalesce(r.new_text, {TOLD}))::VARCHAR || '}}}}],"n":1.50}}'
      || chr(10) || chr(10) || 'data:  not json' || chr(10) || chr(10) || 'data: {{"note":' || to_json(role)::VARCHAR || '}}' || chr(10) || 'retry: 5' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)) END AS body_md5
  FROM t LEFT JOIN h ON h.k = t.request_id LEFT JOIN final f ON f.k = t.request_id LEFT JOIN rewritten r ON r.k = t.request_id AND r.leaf_seq = 0""")
def stream_outcomes(spark, sf):
    """Event streams of the turns' texts masked event by event and rebuilt; other lines stay as they are."""
    told = F.expr("to_json(array(concat(text, ' write to bob', n, '@example.com or 10.0.0.', n % 250)))")
    quoted = F.substring(told, F.lit(2), F.char_length(told) - 2)
    body = F.concat(F.lit('event: delta\r\ndata:{"choices": [{"delta":{"content":'), quoted, F.lit('}}],"n":1.50}\n\ndata:  not json\n\n \n\ndata: '),
                    F.to_json(F.struct(F.col("role").alias("note"))), F.lit("\nretry: 5\n\ndata: [DONE]\n\n"))
    req = turns(spark, sf).select("request_id", body.alias("body"), F.lit("strict").alias("effective_profile"), F.lit("enforce").alias("mode"))
    return C.masked_streams(req).select("request_id", F.col("decision.rule_hits_total").cast("bigint").alias("hits"), "final_action",
                                        F.md5("sanitized_payload").alias("body_md5"))


@add("l15_reassembled_streams", "SELECT conv_id::VARCHAR AS stream_id, md5(string_agg(text, '' ORDER BY turn)) AS body_md5 FROM conversations GROUP BY conv_id")
def reassembled_streams(spark, sf):
    """Chunks of every stream joined in order."""
    chunks = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"))
    return C.reassembled(chunks).select("stream_id", F.md5("body").alias("body_md5"))
