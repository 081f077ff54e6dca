"""Overlap resolution: chains of overlapping hits become one span with one winner.

Two equal forms. ``resolve_in_row`` works on the hit array of a row, needs no shuffle and is what
masking uses. ``resolve_exploded`` works on one row per hit with windows, for hits that come from
several tables; its groups are single leaves, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.arrays import cut_at, folded_before, let, numbers_before
from veilframe.operators.rules import ACTIONS

SPAN_FIELDS = (
    "leaf_seq:int,ptr:string,st:int,en:int,rule_id:string,category:string,action:string,rank:int,"
    "priority:int,template:string,suppressed:array<string>"
)
SPAN_TYPE = f"array<struct<{SPAN_FIELDS}>>"


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def hit_order(hits: Column) -> Column:
    """Sort by pointer, start, longest, strongest, rule id."""
    keyed = F.transform(hits, lambda h: F.struct(
        h["ptr"].alias("k1"), h["st"].alias("k2"), (-h["en"]).alias("k3"), (-h["priority"]).alias("k4"),
        h["rule_id"].alias("k5"), h["leaf_seq"].alias("k6"), h["rule_seq"].alias("k7"),
        h["match_seq"].alias("k8"), h.alias("hit"),
    ))
    return F.transform(F.sort_array(keyed), lambda k: k["hit"])


def islands(ordered: Column) -> Column:
    """Sorted hits as arrays of those that hang together: a hit joins the island before it when it starts before
    that island ends.

    An island ends where the latest of all hits before, of the same pointer, does. Pointers are parted first, so
    that only numbers are folded.
    """
    def of_pointer(run: Column) -> Column:
        return let(F.transform(run, lambda h: h["en"]), lambda ends: let(
            numbers_before(ends, lambda a, b: F.greatest(a, b), F.lit(-1)), lambda latest: let(
                F.array_compact(F.transform(run, lambda h, i: F.when(h["st"] >= latest[i], i))), lambda starts: cut_at(run, starts))))

    pointers = F.array_compact(F.transform(ordered, lambda h, i: F.when(
        (i == 0) | ~h["ptr"].eqNullSafe(ordered[F.greatest(i - 1, F.lit(0))]["ptr"]), i)))
    return F.flatten(F.transform(let(pointers, lambda starts: cut_at(ordered, starts)), of_pointer))


def better(a: Column, b: Column) -> Column:
    """Whether hit ``a`` beats ``b``: stricter action, then priority, then the smaller rule id."""
    return (a["rank"] > b["rank"]) | (
        (a["rank"] == b["rank"])
        & ((a["priority"] > b["priority"]) | ((a["priority"] == b["priority"]) & (a["rule_id"] < b["rule_id"])))
    )


def _beaten(members: Column) -> Column:
    """The winner and the rule ids that lost: dethroned winners first (latest first), then those that never led."""
    keys = F.transform(members, lambda h: F.struct(
        h["rank"].alias("rank"), h["priority"].alias("priority"), h["rule_id"].alias("rule_id")))

    def told(led: Column) -> Column:
        led_ids = F.transform(F.filter(led, lambda x: x["leads"]), lambda x: x["i"])
        never = F.transform(F.filter(led, lambda x: ~x["leads"]), lambda x: members[x["i"]]["rule_id"])
        return let(led_ids, lambda ids: F.struct(
            members[F.element_at(ids, -1)].alias("lead"),
            F.concat(F.transform(F.reverse(F.slice(ids, F.lit(1), F.size(ids) - 1)), lambda i: members[i]["rule_id"]), never).alias("lost")))

    def marked(best: Column) -> Column:
        return let(F.transform(members, lambda h, i: F.struct(
            F.coalesce(better(h, best[i]), F.lit(True)).alias("leads"), i.alias("i"))), told)

    return let(folded_before(keys, lambda a, b: F.when(better(b, a), b).otherwise(a)), marked)


def to_spans(island_col: Column) -> Column:
    def span(first: Column, en: Column, lead: Column, lost: Column) -> Column:
        return F.struct(
            lead["leaf_seq"].alias("leaf_seq"), first["ptr"].alias("ptr"), first["st"].alias("st"), en.alias("en"),
            lead["rule_id"].alias("rule_id"), lead["category"].alias("category"), lead["action"].alias("action"),
            lead["rank"].alias("rank"), lead["priority"].alias("priority"), lead["template"].alias("template"),
            lost.alias("suppressed"))

    def decided(members: Column) -> Column:
        latest = F.array_max(F.transform(members, lambda h: h["en"]))
        solo = span(members[0], members[0]["en"], members[0], F.array().cast("array<string>"))
        return F.when(F.size(members) == 1, solo).otherwise(
            let(_beaten(members), lambda d: span(members[0], latest, d["lead"], d["lost"])))

    return F.transform(island_col, decided)


def resolve_in_row(hits: Column) -> Column:
    return F.when(F.size(hits) > 0, let(hit_order(hits), lambda ordered: to_spans(islands(ordered)))).otherwise(no_spans())


def resolve_exploded(hits: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per hit in, one row per span out, by gaps and islands inside each leaf.

    ``suppressed`` is sorted here; only the in-row form keeps the order of defeat.
    """
    order = (F.col("st"), F.col("en").desc(), F.col("priority").desc(), F.col("rule_id"))
    leaf = Window.partitionBy(key, "ptr")
    before = leaf.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("_new", F.when(F.col("st") < F.max("en").over(before), 0).otherwise(1))
    numbered = marked.withColumn(
        "_island", F.sum("_new").over(leaf.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    names = F.array_sort(F.collect_list("rule_id"))
    # the strongest member: rank and priority high, rule id low
    win = F.min_by(
        F.struct("rule_id", "category", "action", "rank", "priority", "template"),
        F.struct(-F.col("rank"), -F.col("priority"), F.col("rule_id")),
    )
    out = numbered.groupBy(key, "ptr", "_island").agg(
        F.min("st").alias("st"), F.max("en").alias("en"), win.alias("w"), names.alias("_names"))
    at = F.array_position("_names", F.col("w.rule_id")).cast("int")
    return out.select(
        key, "ptr", "st", "en", "w.rule_id", "w.category", "w.action", "w.rank", "w.priority", "w.template",
        F.concat(
            F.slice("_names", F.lit(1), at - 1), F.slice("_names", at + 1, F.size("_names"))
        ).alias("suppressed"),
    )


def final_action(spans: Column) -> Column:
    """The strictest action over the spans, ``allow`` without any."""
    top = F.coalesce(F.array_max(F.transform(spans, lambda s: s["rank"])), F.lit(0))
    return F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), top + 1)
