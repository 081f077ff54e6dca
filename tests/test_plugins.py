"""Plug-ins, SQL helpers, span decoding, resolution of many hits, percentiles and reports."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import sqlfuncs
from veilframe.functions.arrays import folded_before
from veilframe.functions.fragments import stable_pseudonym
from veilframe.operators import evals as EV
from veilframe.operators import metrics as MT
from veilframe.operators import ner as N
from veilframe.operators import plugins as P
from veilframe.operators import resolve as R
from veilframe.operators import sanitize as S
from veilframe.operators import tools as TO
from veilframe.operators.detect import HIT_TYPE
from veilframe.operators.rules import RANK

SPANS = "array<struct<st:int,en:int>>"


def ticket(text, ptr):
    at = F.instr(text, "TICKET-")
    return F.when(at > 0, F.array(F.struct((at - 1).alias("st"), (at + 10).alias("en")))).otherwise(F.array().cast(SPANS))


def requests(spark, *payloads):
    return spark.createDataFrame([(str(k), json.dumps(p), "strict", "enforce") for k, p in enumerate(payloads)],
                                 "request_id string, payload string, effective_profile string, mode string")


def test_plugin_hits_resolve_with_rules(spark):
    registry = P.Registry()
    registry.add(P.Recognizer("custom.ticket", "pii", 400, ticket))
    registry.add(P.Recognizer("custom.beyond", "secrets", 1, lambda text, ptr: F.array(F.struct(F.lit(0).alias("st"), F.lit(10**6).alias("en")))))
    df = requests(spark, {"a": "see TICKET-1234 or bob@example.com"}, {"a": "bob.TICKET-1234@example.com"}, {"n": 1})
    got = {r.request_id: r for r in P.evaluate_with_plugins(df, registry, trace=True).collect()}
    assert json.loads(got["0"].sanitized_payload) == {"a": "see [REDACTED] or [REDACTED]"}
    assert [(s.rule_id, s.st, s.en, list(s.suppressed)) for s in got["1"].spans] == [("custom.ticket", 0, 27, ["builtin.pii.email"])]
    assert json.loads(got["2"].sanitized_payload) == {"n": 1} and got["0"].decision.rule_hits_total == 2


@pytest.mark.parametrize("found", [
    lambda text, ptr: F.array(F.struct(F.lit(0).alias("st"), F.lit(1).alias("en"), F.lit("allow").alias("action"))),
    lambda text, ptr: F.array(F.struct(F.lit(0).alias("st"))), lambda text, ptr: text])
def test_plugins_cannot_decide(spark, found):
    registry = P.Registry()
    registry.add(P.Recognizer("custom.x", "pii", 1, found))
    with pytest.raises(ValueError, match="must give"):
        P.with_plugin_hits(requests(spark, {}), registry)


def test_registry_checks():
    registry = P.Registry()
    registry.add(P.Recognizer("custom.x", "pii", 1, ticket))
    for wrong in (("custom.x", "pii", 1), ("builtin.x", "pii", 1), ("custom.y", "place", 1), ("custom.y", "pii", -1)):
        with pytest.raises(ValueError):
            registry.add(P.Recognizer(*wrong, ticket))


def test_compare_runners(spark):
    cases = spark.createDataFrame([(i, ("allow", "redact", "block")[i % 3]) for i in range(12)], "case_id int, expected string")
    runners = {"all": lambda c: c.select("case_id", F.col("expected").alias("final_action")),
               "half": lambda c: c.filter("case_id < 6").select("case_id", F.lit("redact").alias("final_action")),
               "twice": lambda c: c.select("case_id", F.col("expected").alias("final_action")).union(c.limit(1).selectExpr("case_id", "'allow'"))}
    got = {r.runner: r for r in P.compare_runners(cases, runners).collect()}
    assert tuple(got["all"])[1:7] == (12, 12, 12, 8, 0, 0) and got["all"].f1 == 1.0
    assert tuple(got["half"])[1:7] == (12, 6, 2, 4, 2, 4) and got["twice"].answered == 11


def test_sql_helpers(spark):
    sqlfuncs.register(spark)
    values = ["", "a", "customer é", "x" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select(F.expr("fnv_id_hash(v)").alias("a"), stable_pseudonym(F.col("v")).alias("b")).collect():
        assert r.a == r.b
    paths = ["a/b", "a//./b/../c", "../x", "/abs", "C:\\x", "a\\b", "\\\\share", "", None, "a/../.."]
    df = spark.createDataFrame([(v,) for v in paths], "v string")
    for r in df.select(F.expr("path_segments(v)").alias("a"), TO.path_segments(F.col("v")).alias("b")).collect():
        assert r.a == r.b


def plain_fold(items):
    best, out = None, []
    for x in items:
        out.append(best)
        best = x if best is None or x > best else best
    return out


def test_folded_before(spark):
    r = random.Random(5)
    rows = [(k, [r.randint(0, 99) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 31, 32, 33, 64, 65, 200, 1024, 1025, 5000])]
    df = spark.createDataFrame(rows, "k int, a array<int>")
    got = {x.k: x.m for x in df.select("k", folded_before(F.col("a"), lambda p, q: F.greatest(p, q)).alias("m")).collect()}
    assert got == {k: plain_fold(a) for k, a in rows}


def random_hits(r, n, wide):
    actions = list(RANK)
    out = []
    for i in range(n):
        st, action, leaf = r.randrange(wide), r.choice(actions), r.randrange(3)
        out.append((leaf, f"/{'bca'[leaf]}", 0, i, f"rule{r.randrange(5)}", "pii", st, st + r.randint(1, 12), action, RANK[action], r.randrange(3), None))
    return out


def plain_spans(hits):
    """One pass in order, winners and losers as they come."""
    out = []
    for h in sorted(hits, key=lambda h: (h[1], h[6], -h[7], -h[10], h[4], h[0], h[2], h[3])):
        key = lambda x: (x[9], x[10], [-ord(c) for c in x[4]])
        if out and out[-1]["ptr"] == h[1] and h[6] < out[-1]["en"]:
            s = out[-1]
            s["en"] = max(s["en"], h[7])
            if key(h) > key(s["lead"]):
                s["fallen"].insert(0, s["lead"][4])
                s["lead"] = h
            else:
                s["never"].append(h[4])
        else:
            out.append({"ptr": h[1], "st": h[6], "en": h[7], "lead": h, "fallen": [], "never": []})
    return [(s["ptr"], s["st"], s["en"], s["lead"][4], s["lead"][8], s["fallen"] + s["never"]) for s in out]


def test_resolution_equals_one_pass(spark):
    r = random.Random(9)
    rows = [(k, random_hits(r, n, wide)) for k, (n, wide) in enumerate([(0, 9), (1, 9), (5, 20), (40, 60), (40, 2000), (300, 400), (300, 30)] * 3)]
    df = spark.createDataFrame(rows, f"k int, hits {HIT_TYPE}")
    for x in df.select("k", R.resolve_in_row(F.col("hits")).alias("s")).collect():
        assert [(s.ptr, s.st, s.en, s.rule_id, s.action, list(s.suppressed)) for s in x.s] == plain_spans(rows[x.k][1])


def test_many_hits_in_one_row_stay_linear(spark):
    hits = ("transform(sequence(0, {} - 1), i -> named_struct('leaf_seq', 0, 'ptr', '/a', 'rule_seq', 0, 'match_seq', i, 'rule_id', concat('r', i % 7), "
            "'category', 'pii', 'st', {}, 'en', {} + 3, 'action', 'redact', 'rank', 3, 'priority', i % 5, 'template', cast(null as string)))")

    def seconds(rows, n, place):
        df = spark.range(rows, numPartitions=1).select(F.expr(hits.format(n, place, place)).cast(HIT_TYPE).alias("hits"))
        began = time.time()
        df.select(F.size(R.resolve_in_row(F.col("hits"))).alias("n")).agg(F.sum("n")).collect()
        return time.time() - began

    for place in ("i * 2", "i div 2"):  # one island of all, and islands of a few
        seconds(2, 500, place)
        small = min(seconds(10, 2000, place) for _ in range(2))
        assert seconds(1, 20_000, place) < 4 * small + 1


def test_greedy_equals_brute_force():
    r = random.Random(1)
    for _ in range(200):
        hits = [(s := r.randrange(30), s + r.randint(1, 8), r.choice([0.1, 0.5, 0.5, 0.9])) for _ in range(r.randint(0, 25))]
        kept = []
        for h in sorted(hits, key=lambda h: (-h[2], h[0], h[1])):
            if not any(h[0] < k[1] and k[0] < h[1] for k in kept):
                kept.append(h)
        assert N.greedy(hits) == sorted(kept)


def test_decoded_spans(spark):
    token = lambda label, st, *logits: (label, st, st + 2, list(logits))
    toks = [token("I-PER", 0, 5.0, 0.0), token("I-PER", 3, 0.0, 0.0), token("O", 6, 1.0), token("I-PER", 9, 9.0, 0.0), token("B-PER", 12, 0.0, 9.0),
            token("I-ORG", 15, 1.0, 1.0, 1.0), token("I-ORG", 18, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(toks,), ([],), (None,)], "t array<struct<label:string,st:int,en:int,logits:array<double>>>")
    full, empty, none = (r.s for r in df.select(N.bio_spans(F.col("t")).alias("s")).collect())
    assert [(s.entity, s.first_token, s.last_token, s.st, s.en) for s in full] == [("PER", 0, 1, 0, 5), ("PER", 3, 3, 9, 11), ("PER", 4, 4, 12, 14), ("ORG", 5, 6, 15, 20)]
    assert [round(s.score, 3) for s in full] == [0.747, 1.0, 1.0, 0.333] and empty == [] and none is None
    high = df.select(N.bio_spans(F.col("t"), 0.7).alias("s")).first().s
    assert [s.st for s in high] == [0, 9, 12]


def test_percentiles_equal_sorting(spark):
    r = random.Random(6)
    rows = [("hot", r.randrange(50_000)) for _ in range(4000)] + [("ties", 7)] * 50 + [("one", 3)] + [(None, v) for v in range(100)] + [("hot", None)] * 9
    got = {x.g: (x.p0, x.p50, x.p99, x.p100) for x in MT.nearest_rank(spark.createDataFrame(rows, "g string, v int"), "v", [0, 50, 99, 100], "g").collect()}
    for g in ("hot", "ties", "one", None):
        v = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == tuple(v[(len(v) - 1) * p // 100] for p in (0, 50, 99, 100))


def test_label_reports(spark):
    rows = [("a", "s1", k) for k in range(9)] + [("b", "s2", 3), ("b", "s1", 8), ("c", "s3", 1)]
    labels = spark.createDataFrame(rows, "label string, source string, row_idx int")
    gaps = {r.label: r for r in EV.label_gaps(labels, spark.createDataFrame([("a",)], "label string")).collect()}
    assert (gaps["a"].share, gaps["b"].datasets, gaps["b"].bucket, gaps["a"].bucket) == (0.75, "s1,s2", "low", "high")
    mapping = spark.createDataFrame([("a", "person"), ("b", "person"), ("c", "place"), ("d", "place")], "label string, entity string")
    got = EV.expansion_candidates(labels, mapping, spark.createDataFrame([("a",)], "label string"), top=5).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, "b", "person", 2, "s1", 8), (2, "c", "place", 1, "s3", 1)]


def test_result_envelopes(spark):
    bodies = ['{"result":{"content":"x","content_type":"t","truncated":true}}', '{"result":{"y":1},"content":"outer"}', '{"result":7,"content":"c"}',
              '{"a":1}', '"text"', None, '{"result":{"content":null}}']
    got = [tuple(r.e) for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(TO.result_envelope(F.col("b")).alias("e")).collect()]
    assert got == [("x", "t", True, None), (None, None, False, "result.content required"), ("c", None, False, None), ('{"a":1}', None, False, None),
                   ('"text"', None, False, None), (None, None, False, None), (None, None, False, None)]


def test_hits_are_unchanged_by_plugins_absence(spark):
    df = requests(spark, {"a": "mail bob@example.com"})
    assert P.evaluate_with_plugins(df, P.Registry()).first().sanitized_payload == S.evaluate(df).first().sanitized_payload
    assert isinstance(P.with_plugin_hits(df, P.Registry()).schema["plugin_hits"].dataType, T.ArrayType)
