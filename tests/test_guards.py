"""Nothing unscanned leaves, and no row is lost."""

import json

from pyspark.sql import functions as F

from veilframe.functions import leaves as L
from veilframe.operators import chat as C
from veilframe.operators import ner as N
from veilframe.operators import sanitize as S
from veilframe.operators import tools as T
from veilframe.operators.rules import DEFAULT_POLICY, Policy, Profile
from veilframe.sources.tables import known_size

MAIL = "bob@example.com"


def _requests(spark, payloads):
    rows = [(str(k), "strict", "enforce", p, "en") for k, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "request_id string, profile_id string, mode string, payload string, effective_language string")


def test_unparsable_payloads_are_rejected_and_blocked(spark):
    deep = "[" * 100_000 + json.dumps(MAIL) + "]" * 100_000
    bad = ['{"a": "' + MAIL, '{"a": NaN, "b": "' + MAIL + '"}', '{"a": "\\ud800 ' + MAIL + '"}', deep]
    requests = _requests(spark, bad)
    good, rejected = S.split_requests(requests)
    assert good.count() == 0
    assert {r["error"] for r in rejected.collect()} == {"invalid_input:payload"}
    out = S.evaluate(requests.withColumn("effective_profile", F.lit("strict"))).collect()
    assert all(r["blocked"] and r["sanitized_payload"] is None for r in out)


def test_blank_ids_of_any_white_space_are_rejected(spark):
    rows = _requests(spark, ['{"a":"b"}']).withColumn("request_id", F.lit("\t "))
    assert S.split_requests(rows)[1].first()["error"] == "invalid_input:request_id"


def test_many_hits_are_all_masked(spark):
    text = " ".join(f"user{k}@example.com" for k in range(5000))
    row = S.sanitize_text(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["blocked"] or "@example.com" not in row["sanitized_text"]
    assert len(row["hits"]) >= 5000 and row["dropped_hits"] == 0


def test_explicit_limit_blocks_the_row(spark):
    strict = DEFAULT_POLICY.by_id["strict"]
    policy = Policy((Profile("strict", strict.actions, max_hits=2),), "strict")
    text = " ".join(f"user{k}@example.com" for k in range(5))
    row = S.sanitize_text(spark.createDataFrame([(text,)], "t string"), "t", policy=policy).first()
    assert row["blocked"] and row["sanitized_text"] is None and row["dropped_hits"] == 3


def test_numbers_keep_their_text(spark):
    df = spark.createDataFrame([('{"a":1.10,"b":1e400,"c":-0,"d":"x"}',)], "p string")
    new = F.create_map(F.lit("/d"), F.lit("y"))
    assert df.select(L.set_json_leaves("p", new).alias("o")).first()["o"] == '{"a":1.10,"b":1e400,"c":-0,"d":"y"}'


def test_container_kinds_of_numeric_keys(spark):
    schema = '{"type":"object","properties":{"a":{"type":"object"},"b":{"type":"array"}}}'
    calls = spark.createDataFrame(
        [('{"a":{"0":1,"x":2},"b":[{}]}',), ('{"a":[1],"b":{"0":1}}',), ("[1]",)], "arguments string").withColumns({
            "schema": F.lit(schema), "required": F.array().cast("array<string>"), "forbidden": F.array().cast("array<string>"),
            "path_prefixes": F.array().cast("array<string>"), "max_depth": F.lit(None).cast("int"),
            "max_string_length": F.lit(None).cast("int")})
    assert [r["schema_violations"] for r in T.argument_violations(calls).collect()] == [0, 2, None]


def test_streams_of_any_size_come_back(spark):
    chunks = spark.createDataFrame([("s", 1, "b" * 3_000_000), ("s", 0, "a")], "stream_id string, seq long, chunk string")
    assert C.reassembled(chunks).select(F.length("body")).first()[0] == 3_000_001


def test_policy_tables_are_broadcast(spark):
    servers = known_size(spark, [("x", True, ["t"], [])], "id string, enabled boolean, allowed array<string>, blocked array<string>")
    calls = spark.range(10).select(F.col("id").cast("string").alias("server"))
    joined = calls.join(servers.withColumnRenamed("id", "server"), "server", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_null_texts_pass_the_model(spark):
    df = spark.createDataFrame([(1, None), (2, "ab"), (3, "ab")], "id int, t string")
    got = N.recognize_distinct(df, "t", lambda: lambda texts: [[("person", 0, len(t), 0.5, "en")] for t in texts])
    assert sorted((r.id, r.status, len(r.ner_spans)) for r in got.collect()) == [(1, "ok", 0), (2, "ok", 1), (3, "ok", 1)]


def test_equal_scores_go_to_the_earlier_model(spark):
    df = spark.createDataFrame([(1, 1, "person", 0, 4, 0.5), (1, 0, "organization", 0, 4, 0.5)],
                               "text_id int, model_idx int, entity string, st int, en int, score double")
    assert N.merge_union(df).first()["entity"] == "organization"


def test_defaults_need_no_join_on_a_constant(spark):
    models = known_size(spark, [(0, "en", 10), (1, "ru", 20)], "idx bigint, language string, priority int")
    picked = N.pick_models(spark.createDataFrame([("en",), ("xx",)], "lang string"), models, "ru")
    assert {r.lang: r.model_idx for r in picked.collect()} == {"en": 0, "xx": 1}
    assert "NestedLoop" not in picked._jdf.queryExecution().executedPlan().toString()
