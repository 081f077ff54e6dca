"""Work per match and per span stays small however many there are in a row."""

import json
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from veilframe.functions import fragments as FR
from veilframe.functions import leaves as LV
from veilframe.functions import match as M
from veilframe.functions.arrays import numbers_before
from veilframe.operators import ner as N
from veilframe.operators import sanitize as S
from veilframe.operators.audit import leaked_values
from veilframe.operators.rules import BUILTIN_RULES


def seconds(df, column):
    """The best of three runs."""
    took = []
    for _ in range(3):
        start = time.perf_counter()
        df.select(column.alias("x")).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - start)
    return min(took)


def test_offsets_cost_little_more_than_cutting_the_text(spark):
    df = spark.range(8, numPartitions=4).select(F.repeat(F.concat(F.lit("Lorem ipsum "), F.col("id").cast("string")), 20000).alias("t")).cache()
    df.count()
    cut = seconds(df, F.expr("transform(split(regexp_replace(t, '(?U)[A-Za-z]+', '#$0#'), '#', -1), p -> char_length(p))"))
    assert seconds(df, M.match_spans("t", "[A-Za-z]+")) < 10 * cut


def test_offsets_over_several_blocks(spark):
    text = "".join(f"ä{'x' * (i % 7 + 1)} " for i in range(3000))
    got = spark.createDataFrame([(text,)], "t string").select(M.match_spans("t", "x+").alias("s")).first().s
    assert len(got) == 3000 and all(text[s.st:s.en] == s.v and set(s.v) == {"x"} for s in got)


def test_many_spans_cost_little_more_than_few_in_a_long_text(spark):
    text = F.repeat(F.lit("ä234567890"), 100000)
    spans = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(
        (i * 500).alias("st"), (i * 500 + 8).alias("en"), F.lit("redact").alias("action"), F.lit(None).cast("string").alias("template")))
    many, few = (spark.range(4, numPartitions=4).withColumn("n", F.lit(n)).select(text.alias("t"), spans.alias("s")).cache()
                 for n in (2000, 20))
    assert many.count() == few.count()
    rewritten = FR.apply_spans(F.col("t"), F.col("s"), 4)
    assert seconds(many, rewritten) < 5 * seconds(few, rewritten)


def test_spans_over_chunk_borders(spark):
    text = "".join("ä😀b\nc"[i % 5] for i in range(2000))
    places = [(0, 3), (250, 256), (256, 257), (257, 900), (1023, 1025), (1998, 2005)]
    df = spark.createDataFrame([(text, [(a, b, "redact", None) for a, b in places])],
                               "t string, s array<struct<st:int,en:int,action:string,template:string>>")
    got = df.select(FR.apply_spans(F.col("t"), F.col("s"), 4)).first()[0]
    want, at = "", 0
    for a, b in places:
        want, at = want + text[at:a] + FR.REDACTED, b
    assert got == want + text[at:]


def test_spans_of_labels_alone(spark):
    """Without a score no probability is worked out, so tokens need no logits."""
    labels = ["O", "I-PER", "I-PER", "O", "I-PER", "B-PER", "I-ORG", None, "I-ORG", "X-PER"]
    df = spark.createDataFrame([([(x, 2 * i, 2 * i + 1) for i, x in enumerate(labels)],), ([],), (None,)], "t array<struct<label:string,st:int,en:int>>")
    full, empty, none = (r.s for r in df.select(N.bio_spans(F.col("t"), scored=False).alias("s")).collect())
    assert [tuple(s) for s in full] == [("PER", 1, 2, 2, 5), ("PER", 4, 4, 8, 9), ("PER", 5, 5, 10, 11), ("ORG", 6, 6, 12, 13), ("ORG", 8, 8, 16, 17)]
    assert empty == [] and none is None


def test_running_fold_over_numbers(spark):
    rows = [(n, [(i * 7919) % 1009 for i in range(n)]) for n in (0, 1, 3, 4, 5, 63, 64, 65, 1024, 1025, 5000)]
    df = spark.createDataFrame(rows, "n int, a array<int>")
    for x in df.select("n", "a", numbers_before(F.col("a"), lambda p, q: F.greatest(p, q), F.lit(-1)).alias("m")).collect():
        want, top = [], -1
        for v in x.a:
            want.append(top)
            top = max(top, v)
        assert x.m == want


def test_every_rule_on_free_text_has_a_guard(spark):
    assert [r.rule_id for r in BUILTIN_RULES if not (r.guard or r.gate)] == []
    samples = ["ip 10.0.0.255.", "call 8 900 123 45 67", "call (800) 5551234", "MRN-12345", "MED12345678", "A1234567", "AB\u00a0123", "ABC 123",
               "AB12345678", "N Main", "N\u2003Abc", "7 Avenida abc", "12 ab cd St", "1 Aa Marg", "4111 1111-1111 1111", "\u0664" * 13, "A\u0661\u0662\u0663\u0664\u0665\u0666\u0667"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").withColumn("low", F.lower("t"))
    found = 0
    for rule in (r for r in BUILTIN_RULES if r.guard):
        raw = F.size(M.match_spans("t", rule.pattern)) > 0
        found += df.filter(raw).count()
        assert df.filter(raw & ~F.expr(M.GUARDS[rule.guard]("t", "low"))).count() == 0, rule.rule_id
    assert found >= len(samples)


def test_memory_does_not_grow_with_the_batch(spark):
    payload = json.dumps({"messages": [{"content": "some words " * 20, "role": "user"}] * 3})
    new = [("/messages/0/content", "other words " * 20)]

    def peak(n):
        batch = pa.array([payload] * n), pa.array([new] * n, pa.map_(pa.string(), pa.string()))
        tracemalloc.start()
        assert len(LV.json_nodes.func(batch[0])) == len(LV.set_json_leaves.func(*batch)) == n
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    peak(10)
    assert LV.json_nodes.func(pa.array([], pa.string())).type == LV.NODE_ARROW and peak(4000) < 2 * peak(500)


def test_leaks_are_looked_for_inside_the_row(spark):
    req = spark.createDataFrame([("r1", "direct", "zebra-1"), ("r2", "zebra-2", "zebra-3")], "request_id string, a string, b string").select(
        "request_id", F.lit("strict").alias("effective_profile"), F.lit("enforce").alias("mode"), F.lit("direct").alias("path_class"),
        F.lit("en").alias("effective_language"), F.struct(F.col("a").alias("client_id"), F.col("b").alias("customer_id")).alias("payload"))
    leaks = leaked_values(S.evaluate(req, trace=True))
    assert [tuple(x) for x in leaks.collect()] == [("r1", "direct")]
    exploded = [line for line in leaks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in line]
    assert len(exploded) == 1 and "explode(leaks" in exploded[0]
