"""Extension points: recognizers that add hits, and runners that an evaluation compares.

A recognizer sees a leaf and tells spans. What happens to them is the policy's business, so its output
may hold nothing but places, and it cannot change the payload.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import leaves as L
from veilframe.functions.arrays import pinned
from veilframe.operators.detect import HIT_TYPE, RANK_MAP
from veilframe.operators.evals import scores
from veilframe.operators.rules import CATEGORIES, DEFAULT_POLICY, MAX_PRIORITY, Policy
from veilframe.operators.sanitize import evaluate, with_leaves

#: Places of plug-in hits among the rules of a row: behind the rules, before the entity model.
RULE_SEQ = 900_000
SPAN_FIELDS = {"st": T.IntegerType(), "en": T.IntegerType()}


@dataclass(frozen=True)
class Recognizer:
    """``find`` turns a leaf's text and pointer (columns) into ``array<struct<st:int,en:int>>``, offsets in characters."""

    rule_id: str
    category: str
    priority: int
    find: Callable[[Column, Column], Column]


class Registry:
    """Recognizers by rule id, in the order of registration."""

    def __init__(self) -> None:
        self.recognizers: dict[str, Recognizer] = {}

    def add(self, recognizer: Recognizer) -> None:
        if recognizer.rule_id in self.recognizers or not recognizer.rule_id.startswith("custom."):
            raise ValueError(f"rule id '{recognizer.rule_id}' is taken or does not start with 'custom.'")
        if recognizer.category not in CATEGORIES:
            raise ValueError(f"unknown category '{recognizer.category}'")
        if not 0 <= recognizer.priority <= MAX_PRIORITY:
            raise ValueError(f"priority must be at most {MAX_PRIORITY}")
        self.recognizers[recognizer.rule_id] = recognizer


def check_output(df: DataFrame, recognizer: Recognizer) -> None:
    """Fail where a recognizer tells more than places: actions, ranks and texts are not its own to decide."""
    kind = df.limit(0).select(recognizer.find(F.lit(""), F.lit("")).alias("found")).schema["found"].dataType
    fields = kind.elementType.fields if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []
    if {f.name: f.dataType for f in fields} != SPAN_FIELDS:
        raise ValueError(f"recognizer '{recognizer.rule_id}' must give array<struct<st:int,en:int>>, not {kind.simpleString()}")


def with_plugin_hits(requests: DataFrame, registry: Registry, *, policy: Policy = DEFAULT_POLICY, payload: str = "payload",
                     output: str = "plugin_hits", processor: L.Processor = L.JSON) -> DataFrame:
    """Adds the hits of all registered recognizers to valid requests, with each profile's action for their category.

    Spans that are null, empty, reversed or beyond the text are left out. One narrow stage.
    """
    for recognizer in registry.recognizers.values():
        check_output(requests, recognizer)
    df = with_leaves(requests, payload, processor=processor)
    actions = F.create_map(*[F.lit(x) for p in policy.profiles for c in CATEGORIES for x in (f"{p.profile_id}/{c}", p.action_for(c))])

    def of_leaves(r: Recognizer, seq: int) -> Column:
        def of_leaf(x: Column) -> Column:
            valid = F.filter(r.find(x["text"], x["ptr"]), lambda s: F.coalesce(
                (s["st"] >= 0) & (s["st"] < s["en"]) & (s["en"] <= F.char_length(x["text"])), F.lit(False)))
            action = F.element_at(actions, F.concat(F.col("effective_profile"), F.lit(f"/{r.category}")))
            return F.transform(valid, lambda s, i: F.struct(
                x["leaf_seq"].alias("leaf_seq"), x["ptr"].alias("ptr"), F.lit(RULE_SEQ + seq).alias("rule_seq"), i.alias("match_seq"),
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), s["st"].alias("st"), s["en"].alias("en"),
                action.alias("action"), F.element_at(F.expr(RANK_MAP), action).alias("rank"), F.lit(r.priority).alias("priority"),
                F.lit(None).cast("string").alias("template")))

        return F.flatten(F.transform("leaves", of_leaf)).cast(HIT_TYPE)

    parts = [of_leaves(r, seq) for seq, r in enumerate(registry.recognizers.values())]
    none = F.array().cast(HIT_TYPE)
    found = F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none
    return df.withColumn(output, pinned(found)).drop("leaves")


def evaluate_with_plugins(requests: DataFrame, registry: Registry, *, policy: Policy = DEFAULT_POLICY, payload: str = "payload",
                          processor: L.Processor = L.JSON, **options) -> DataFrame:
    """``sanitize.evaluate`` in which registered recognizers' hits resolve against all others."""
    found = with_plugin_hits(requests, registry, policy=policy, payload=payload, processor=processor)
    return evaluate(found, policy=policy, payload=payload, processor=processor, extra_hits="plugin_hits", **options).drop("plugin_hits")


# A runner answers cases: ``case_id`` and whatever it reads in, ``case_id, final_action`` out.
Runner = Callable[[DataFrame], DataFrame]


def compare_runners(cases: DataFrame, runners: dict[str, Runner], expected: str = "expected") -> DataFrame:
    """Per runner: cases, answers, matches of the expected action, and how well it tells cases that must not pass.

    A case that a runner leaves out counts as not answered and not matched; a second answer is an error
    of the runner and counts as wrong.
    """
    out = None
    for name, run in runners.items():
        answers = run(cases).groupBy("case_id").agg(F.count("*").alias("_n"), F.any_value("final_action").alias("_a"))
        met = cases.select("case_id", F.col(expected).alias("_e")).join(answers, "case_id", "left").withColumn(
            "_a", F.when(F.col("_n") == 1, F.col("_a")))
        must, did = F.col("_e") != "allow", F.coalesce(F.col("_a") != "allow", F.lit(False))
        row = met.agg(F.count("*").alias("cases"), F.count("_a").alias("answered"), F.count_if(F.col("_a") == F.col("_e")).alias("matched"),
                      F.count_if(must & did).alias("tp"), F.count_if(~must & did).alias("fp"), F.count_if(must & ~did).alias("fn"))
        row = row.select(F.lit(name).alias("runner"), "*", *[F.round(c, 6).alias(n) for n, c in scores(
            F.col("tp"), F.col("fp"), F.col("fn")).items()])
        out = row if out is None else out.unionByName(row)
    return out
