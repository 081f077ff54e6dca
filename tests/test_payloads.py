"""JSON text and event streams: what is scanned, what is replaced, and that all else stays as written."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import events as EV
from veilframe.functions import leaves as L
from veilframe.operators import chat as C
from veilframe.operators import sanitize as S


def requests(spark, payloads):
    return spark.createDataFrame([(str(k), p, "strict", "enforce") for k, p in enumerate(payloads)],
                                 "request_id string, payload string, effective_profile string, mode string")


def texts_of(doc, ptr=""):
    if isinstance(doc, dict):
        return [x for k, v in doc.items() for x in texts_of(v, f"{ptr}/{L.segment(k)}")]
    if isinstance(doc, list):
        return [x for i, v in enumerate(doc) for x in texts_of(v, f"{ptr}/{i}")]
    return [(ptr, doc)] if isinstance(doc, str) else []


def random_json(r, depth=0):
    kind = r.choice("dlsnbx" if depth < 4 else "snbx")
    if kind == "d":
        return {r.choice(["a", "b/c", "d~e", "é", "", 'q"', "\\"]): random_json(r, depth + 1) for _ in range(r.randint(0, 4))}
    if kind == "l":
        return [random_json(r, depth + 1) for _ in range(r.randint(0, 4))]
    return {"s": r.choice(["", "text", 'say "hi"', "tab\t", "\\n", "é🎉", "{}[]:,"]), "n": r.choice([0, -1.5, 10**20]), "b": True, "x": None}[kind]


@pytest.mark.parametrize("seed", range(30))
def test_scanner_agrees_with_the_parser(seed):
    r = random.Random(seed)
    doc = random_json(r)
    raw = json.dumps(doc, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1, "\t"]))
    tree, hidden = L.scan(raw)
    nodes = list(L.walk(tree))
    assert hidden == [] and L.spliced(raw, {}) == raw
    assert sorted((n["ptr"], n["text"]) for n in nodes if n["kind"] == "string") == sorted(texts_of(doc))
    assert all(raw[slice(*n["range"])].strip() == raw[slice(*n["range"])] for n in nodes)
    changed = {ptr: text.upper() + "<3" for ptr, text in texts_of(doc)}
    assert sorted(texts_of(json.loads(L.spliced(raw, changed)))) == sorted(changed.items())


def test_only_replaced_ranges_change():
    raw = ' { "n" : 1.10, "t":"x",\n"u":"\\u00e9", "e": 1E+2, "k":[ "x" , -0 ] } '
    assert L.spliced(raw, {"/t": "ä\n", "/k/0": ""}) == ' { "n" : 1.10, "t":"ä\\n",\n"u":"\\u00e9", "e": 1E+2, "k":[ "" , -0 ] } '


@pytest.mark.parametrize(("raw", "want"), [
    ('{"a":"bob@example.com","a":"fine"}', '{"a":"fine"}'),
    ('{"a": {"b":"bob@example.com","b":1} , "x":2, "a":"al@example.com"}', '{"x":2, "a":"[REDACTED]"}'),
    ('[{"a":1,"b":"x","a":2,"b":"y"}]', '[{"a":2,"b":"y"}]'),
    ('{"\\u0061":"bob@example.com","a":"ok"}', '{"a":"ok"}'),
])
def test_hidden_members_are_not_released(spark, raw, want):
    row = S.evaluate(requests(spark, [raw])).first()
    assert row.sanitized_payload == want


def test_unreadable_payloads_are_rejected_and_read_once(spark):
    df = requests(spark, ['{"a":"bob@example.com"}', "{", None, '{"a":NaN}', '"bob@example.com"', "[" * 5000]).withColumn(
        "profile_id", F.lit("strict")).withColumn("effective_language", F.lit("en")).drop("effective_profile")
    good, bad = S.split_requests(df)
    assert {r.request_id: r.sanitized_payload for r in S.evaluate(good).collect()} == {"0": '{"a":"[REDACTED]"}', "4": '"[REDACTED]"'}
    assert {r.request_id for r in bad.collect()} == {"1", "2", "3", "5"} and "_nodes" not in bad.columns


def test_own_processor(spark):
    """Lines of ``key=value`` as payloads, read and written with built-in functions."""
    pairs = lambda p: F.filter(F.split(p, "\n"), lambda x: F.contains(x, F.lit("=")))
    nodes = lambda p: F.transform(pairs(p), lambda x: F.struct(
        F.concat(F.lit("/"), F.substring_index(x, "=", 1)).alias("ptr"), F.lit("string").alias("kind"),
        F.substring_index(x, "=", -1).alias("text"), F.lit(1).alias("depth"), F.lit(None).cast("string").alias("key"),
        F.lit("string").alias("top")))
    write = lambda p, texts: F.array_join(F.transform(F.split(p, "\n"), lambda x: F.coalesce(F.concat(
        F.substring_index(x, "=", 1), F.lit("="), F.try_element_at(texts, F.concat(F.lit("/"), F.substring_index(x, "=", 1)))), x)), "\n")
    out = S.evaluate(requests(spark, ["user=bob@example.com\nage=7\n# bob", "x=1"]), processor=L.Processor(nodes, write)).collect()
    assert [r.sanitized_payload for r in sorted(out)] == ["user=[REDACTED]\nage=7\n# bob", "x=1"]
    assert sorted(out)[0].decision.rule_hits_total == 1


BODY = ('event: delta\r\ndata:  {"t":"mail bob@example.com", "n":1.50}\nid: 7\n\n \n\ndata: bob@example.com\n\n'
        'data: {"a":{"b":["x","10.0.0.1"]}}\ndata: "al@example.com"\n\ndata: [DONE] \n\n')
MASKED = ('event: delta\ndata: {"t":"mail [REDACTED]", "n":1.50}\nid: 7\n\ndata: bob@example.com\n\n'
          'data: {"a":{"b":["x","[REDACTED]"]}}\ndata: "[REDACTED]"\n\ndata: [DONE]\n\n')


def test_masked_streams(spark):
    df = requests(spark, [BODY, "", None, "\n\n\n\n", "no events", BODY + 'data: {"k":"Bearer abcdefghijklmnopqrstuvwxyz123456"}\n\n']).withColumnRenamed("payload", "body")
    got = {r.request_id: r for r in C.masked_streams(df).collect()}
    assert got["0"].sanitized_payload == MASKED and got["0"].decision.rule_hits_total == 3 and got["0"].final_action == "redact"
    assert [got[k].sanitized_payload for k in "1234"] == ["", None, "", "no events\n\n"] and not got["2"].blocked
    assert got["5"].final_action == "block" and got["5"].sanitized_payload is None


def test_streams_equal_events_one_by_one(spark):
    """The rebuilt body against an evaluation per event."""
    r = random.Random(2)
    docs = [{"text": r.choice(["hello", "bob@example.com", "call 10.0.0.7"]), "k": [r.choice(["x", "al@example.com"])]} for _ in range(30)]
    one = {row.request_id: json.loads(row.sanitized_payload) for row in S.evaluate(requests(spark, [json.dumps(d) for d in docs])).collect()}
    body = "".join(f"id: {k}\ndata: {json.dumps(d)}\n\n" for k, d in enumerate(docs))
    out = C.masked_streams(requests(spark, [body]).withColumnRenamed("payload", "body")).first().sanitized_payload
    events = [e.split("\n") for e in out.split("\n\n") if e]
    assert [e[0] for e in events] == [f"id: {k}" for k in range(30)]
    assert [json.loads(e[1][6:]) for e in events] == [one[str(k)] for k in range(30)]


def test_event_lines_keep_what_is_no_payload():
    assert EV.rebuilt("data:[DONE]\r\n\n\n: note\n\n", {}) == "data: [DONE]\n\n\n: note\n\n"
    assert EV.event_lines(" \x1f\n\n　\n\n") == [[(" \x1f", None)]]


def test_responses_input(spark):
    bodies = ['{"model":"m","input":"hi"}', '{"model":"m","input":{"role":" user ","content":[{"type":"t","n":1}]}}',
              '{"model":"m","input":["a",{"role":"tool","content":"b"}]}', '{"model":"m","input":["a",{"role":"tool"}]}',
              '{"model":"m","input":[[1]]}', '{"model":" ","input":"x"}', '{"model":"m"}', '{"model":"m","input":null}', "[]", None,
              '{"model":"m","input":[]}', '{"model":"m","input":{"role":"user","content":null}}', '{"model":"m","input":[null]}']
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body string")
    got = {r.k: (r.error, r.messages and [tuple(m) for m in r.messages]) for r in C.responses_input(df, "body").collect()}
    assert [got[k] for k in range(13)] == [
        (None, [("user", "hi", None)]), (None, [("user", None, '[{"n":1,"type":"t"}]')]),
        (None, [("user", "a", None), ("tool", "b", None)]), ("input[1].content required", None), ("input[0] unsupported", None),
        ("model required", None), ("input required", None), ("input unsupported", None), ("body not an object", None),
        ("body not an object", None), ("input empty", None), ("input.content unsupported", None), ("input[0] unsupported", None)]
