"""Queries over structured payloads: leaves, paths, depth, token estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import leaves as LV
from veilframe.functions.arrays import explode_once
from veilframe.operators import decide as D
from veilframe.operators import sanitize as S
from veilframe.operators import tokens as TK
from veilframe.plans.detection import PERSON, customer_payload, customer_requests
from veilframe.sources.tables import table

QUERIES, ORACLES = {}, {}
TURN = "concat_ws('-', cast(conv_id as string), cast(turn as string))"


def add(name, oracle=None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


def chat_payload():
    """One chat request per turn: two messages, a tool list, a few scalars."""
    msg = F.struct(F.col("text").alias("content"), F.col("role").alias("role"))
    rules = F.struct(F.lit("keep it short").alias("content"), F.lit("system").alias("role"))
    tool = F.struct(F.lit("lookup").alias("a/b~c"), F.array(F.lit("x"), F.col("role")).alias("enum"))
    return F.struct(F.array(rules, msg).alias("messages"), F.lit("gpt").alias("model"), (F.col("turn") > 2).alias("stream"),
                    F.array(tool).alias("tools"), F.col("turn").alias("turn"))


def chats(spark, sf):
    return table(spark, sf, "conversations").select(F.expr(TURN).alias("request_id"), "role", "text", "turn", chat_payload().alias("payload"))


CHAT = """
  SELECT conv_id || '-' || turn AS request_id, role, leaf_seq, ptr, text FROM (SELECT conv_id, turn, role, v.* FROM conversations, LATERAL (VALUES
    (0, '/messages/0/content', 'keep it short'), (1, '/messages/0/role', 'system'), (2, '/messages/1/content', conversations.text), (3, '/messages/1/role', conversations.role),
    (4, '/model', 'gpt'), (5, '/tools/0/a~1b~0c', 'lookup'), (6, '/tools/0/enum/0', 'x'), (7, '/tools/0/enum/1', conversations.role)) v(leaf_seq, ptr, text))"""
LEAVES = f"SELECT request_id, leaf_seq::BIGINT AS leaf_seq, ptr, md5(text) AS text_md5 FROM ({CHAT})"


def _leaf_rows(df):
    x = explode_once(df, "leaves", "l", "request_id")
    return x.select("request_id", F.col("l.leaf_seq").cast("bigint").alias("leaf_seq"), "l.ptr", F.md5("l.text").alias("text_md5"))


@add("p1_typed_leaves", LEAVES)
def typed_leaves(spark, sf):
    """String leaves of a typed payload, walked through its schema."""
    return _leaf_rows(S.with_leaves(chats(spark, sf), "payload"))


@add("p1_json_leaves", LEAVES)
def json_leaves(spark, sf):
    """The same leaves from JSON text."""
    return _leaf_rows(S.with_leaves(chats(spark, sf).withColumn("payload", F.to_json("payload")), "payload"))


JS = "to_json(replace({}, 'e', '<3'))::VARCHAR"


@add("p2_rewritten_leaves", f"""SELECT conv_id || '-' || turn AS request_id, md5('{{"messages":[{{"content":' || {JS.format("'keep it short'")} || ',"role":' || {JS.format("'system'")} || '}},{{"content":' || {JS.format("text")}
    || ',"role":' || {JS.format("role")} || '}}],"model":"gpt","stream":' || (turn > 2)::VARCHAR || ',"tools":[{{"a/b~c":"lookup","enum":["x",' || {JS.format("role")} || ']}}],"turn":' || turn || '}}') AS document_md5,
  1 + 1 + contains(text, 'e')::INT + 2 * contains(role, 'e')::INT AS changed FROM conversations""")
def rewritten_leaves(spark, sf):
    """Every leaf rewritten in place, the rest of the document as it was, changed leaves counted."""
    df = S.with_leaves(chats(spark, sf).withColumn("payload", F.to_json("payload")), "payload")
    new = F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["ptr"], F.replace(x["text"], F.lit("e"), F.lit("<3")))))
    out = df.withColumn("new", LV.set_json_leaves("payload", new))
    return out.select("request_id", F.md5("new").alias("document_md5"),
                      F.expr("size(filter(leaves, x -> contains(x.text, 'e')))").alias("changed"))


@add("p3_logical_paths", f"""SELECT request_id, CASE leaf_seq WHEN 5 THEN 'tools.0.a/b~c' ELSE replace(substring(ptr, 2), '/', '.') END AS path FROM ({CHAT})""")
def logical_paths(spark, sf):
    """Dotted names of JSON pointers."""
    x = explode_once(S.with_leaves(chats(spark, sf), "payload"), "leaves", "l", "request_id")
    return x.select("request_id", D.logical_path(F.col("l.ptr")).alias("path"))


@add("p4_json_depth", "SELECT event_id, (CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 4 ELSE 3 END)::BIGINT AS depth FROM events")
def json_depth(spark, sf):
    """Nesting depth of event properties wrapped to different depths."""
    props = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit('{"a":[{"b":'), F.get_json_object("props", "$.k"), F.lit('}],"e":{}}'))
    ).otherwise(F.concat(F.lit('{"p":'), F.col("props"), F.lit("}")))
    nodes = table(spark, sf, "events").select("event_id", LV.json_nodes(props).alias("nodes"))
    return nodes.select("event_id", LV.json_depth(F.col("nodes")).cast("bigint").alias("depth"))


@add("p5_json_token_units", "SELECT event_id, greatest(1, octet_length(encode(json(props)::VARCHAR)) // 4)::BIGINT AS units FROM events")
def json_token_units(spark, sf):
    """Token units from the compact JSON size."""
    compact = F.to_json(F.expr("parse_json(props)"))
    return table(spark, sf, "events").select("event_id", TK.json_units(compact).cast("bigint").alias("units"))


@add("p6_leaf_token_units", f"SELECT request_id, (sum(greatest(1, length(text) // 4)) + 1)::BIGINT AS units FROM ({CHAT}) GROUP BY ALL")
def leaf_token_units(spark, sf):
    """Token units from leaf lengths (plus one for the turn number)."""
    df = chats(spark, sf).select("request_id", LV.json_nodes(F.to_json("payload")).alias("nodes"))
    return df.select("request_id", TK.leaf_units(F.col("nodes")).alias("units"))


@add("p7_responses_token_units", "SELECT conv_id || '-' || turn AS request_id, (greatest(1, length(text) // 4) + 2)::BIGINT AS units FROM conversations")
def responses_token_units(spark, sf):
    """Only the input of a responses payload counts."""
    body = F.to_json(F.struct(F.lit("gpt").alias("model"), F.array(F.col("text"), F.lit("abc"), F.lit("ok then")).alias("input")))
    df = table(spark, sf, "conversations").select(F.expr(TURN).alias("request_id"), LV.json_nodes(body).alias("nodes"))
    return df.select("request_id", TK.responses_units(F.col("nodes")).alias("units"))


@add("p8_protected_subtree", f"SELECT DISTINCT k::VARCHAR AS request_id, lpad(k::VARCHAR, 10, '0') AS account_number, '[REDACTED]' AS customer_id FROM ({PERSON})")
def protected_subtree(spark, sf):
    """A protected pointer is scanned but never rewritten."""
    out = S.evaluate(customer_requests(spark, sf), protect="/account_number")
    return out.select("request_id", "sanitized_payload.account_number", "sanitized_payload.customer_id")
