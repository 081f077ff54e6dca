"""Decision, explain and audit columns over the hits and spans of a row. Metadata only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.operators.detect import recognizer_family
from veilframe.operators.rules import CATEGORIES

FAMILIES = ("builtin", "custom", "deterministic", "ner")
# The stage names a completed run reports.
STAGES = (
    "input_normalization", "recognizer_execution", "analysis_and_suppression", "policy_resolution",
    "transformation", "safe_explain", "audit_summary",
)


def count_where(arr: Column, cond) -> Column:
    return F.size(F.filter(arr, cond))


def _in_category(category: str):
    return lambda h: h["category"] == category


def _in_family(family: str):
    return lambda h: recognizer_family(h["rule_id"]) == family


def hits_by_category(hits: Column) -> Column:
    """Categories with at least one raw hit, as a map."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("k"), count_where(hits, _in_category(c)).alias("v"))
        for c in sorted(CATEGORIES)
    ])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0))


def hits_by_family(hits: Column, spans: Column) -> Column:
    """All families, zero included, with the totals before and after resolution."""
    parts = [F.lit("normalized_hit"), F.size(hits), F.lit("resolved_hit"), F.size(spans)]
    for family in FAMILIES:
        parts += [F.lit(family), count_where(hits, _in_family(family))]
    return F.create_map(*parts)


def deterministic_candidates(hits: Column) -> Column:
    return count_where(hits, lambda h: F.startswith(h["rule_id"], F.lit("deterministic.")))


def suppressed_total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + F.size(s["suppressed"]))


def winner_codes(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit("winner:"), s["rule_id"]))


def explain_codes(spans: Column, reason_codes: Column | None = None) -> Column:
    policy = F.transform(spans, lambda s: F.concat_ws(":", s["category"], s["action"]))
    return F.array_sort(F.array_distinct(F.concat(winner_codes(spans) if reason_codes is None else reason_codes, policy)))


def logical_path(ptr: Column) -> Column:
    """``/a/b~1c`` becomes ``a.b/c``; empty segments vanish."""
    parts = F.filter(F.split(ptr, "/"), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.array_join(plain, ".")


def locations(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        F.lit("json_field").alias("location_kind"), s["ptr"].alias("json_pointer"),
        logical_path(s["ptr"]).alias("logical_field_path"), s["category"].alias("category"),
        s["action"].alias("effective_action"), s["st"].alias("st"), s["en"].alias("en"),
    ))


def provenance(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        spans, lambda s: F.when(F.startswith(s["rule_id"], F.lit("custom.")), "custom_rule").otherwise("built_in_rule"))))


def explain_categories(hits: Column, spans: Column) -> Column:
    """Per category: raw hits and the strictest action among resolved spans, allow when none is left."""
    def strictest(c):
        of_cat = F.filter(spans, _in_category(c))
        top = F.array_max(F.transform(of_cat, lambda s: F.struct(s["rank"].alias("rank"), s["action"].alias("action"))))
        return F.coalesce(top["action"], F.lit("allow"))

    entries = F.array(*[
        F.struct(
            F.lit(c).alias("category"), count_where(hits, _in_category(c)).alias("hits"),
            strictest(c).alias("effective_action"))
        for c in sorted(CATEGORIES)
    ])
    return F.filter(entries, lambda e: e["hits"] > 0)


def replay_identity(spans: Column, *parts: Column) -> Column:
    """Equal inputs and spans give equal ids: a portable hash over profile, mode, path, filters, spans."""
    compact = F.transform(spans, lambda s: F.struct(
        s["ptr"].alias("p"), s["st"].alias("s"), s["en"].alias("e"), s["rule_id"].alias("r"),
        s["category"].alias("c"), s["action"].alias("a"), s["priority"].alias("n")))
    doc = F.to_json(F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)], compact.alias("spans")))
    return F.substring(F.sha2(doc, 256), 1, 16)


def transform_metadata(blocked: Column, changed: Column) -> Column:
    return F.when(blocked, F.array(F.lit("policy_block"))).when(
        changed == 0, F.array(F.lit("pass_through"))).otherwise(F.array(F.lit("json_string_leaf_mutation")))


def operator_mapping(spans: Column, visible: int | Column) -> Column:
    visible = F.lit(visible) if isinstance(visible, int) else visible

    def one(s):
        base = F.concat_ws(":", s["rule_id"], s["action"])
        return (
            F.when(s["action"] == "mask", F.concat(base, F.lit(":visible_suffix="), visible.cast("string")))
            .when(s["action"] == "replace", F.concat(
                base, F.lit(":template="), F.coalesce(s["template"], F.lit("[REPLACED]"))))
            .otherwise(base)
        )

    return F.transform(spans, one)


def transform_order(spans: Column, final: Column) -> Column:
    return (
        F.when(final == "block", F.array(F.lit("policy_block")))
        .when(F.size(spans) == 0, F.array(F.lit("pass_through")))
        .otherwise(F.array(F.lit("stable_span_order"), F.lit("json_string_leaf_mutation")))
    )


def transform_plan(spans: Column, final: Column, mode: Column, visible: int | Column) -> Column:
    return F.struct(
        final.alias("final_action"), operator_mapping(spans, visible).alias("per_hit_operator_mapping"),
        transform_order(spans, final).alias("transform_order"), mode.alias("mode"))


def execution_enabled(mode: Column) -> Column:
    """Dry run only switches this flag; masking and blocking happen either way."""
    return mode == "enforce"


def degradation_markers(enabled: Column, degraded: Column, fail_closed: Column) -> Column:
    return F.array_compact(F.array(
        F.when(~enabled, "execution_disabled"), F.when(degraded, "degraded_execution"),
        F.when(fail_closed, "fail_closed_applied")))


def degradation_metadata(enabled: Column, degraded: Column, fail_closed: Column) -> Column:
    return F.array_compact(F.array(
        F.concat(F.lit("execution_enabled="), enabled.cast("string")),
        F.concat(F.lit("is_degraded="), degraded.cast("string")),
        F.when(fail_closed, "fail_closed_applied=true")))


def normalized_hits(hits: Column) -> Column:
    """The shared candidate shape: scores and provenance, no text."""
    from veilframe.operators.detect import evidence_class

    return F.transform(hits, lambda h: F.struct(
        h["rule_id"].alias("rule_id"), h["category"].alias("category"),
        F.lit("json_pointer").alias("location_kind"), h["ptr"].alias("json_pointer"),
        h["st"].alias("st"), h["en"].alias("en"), h["action"].alias("action_hint"),
        h["priority"].alias("final_score"), h["priority"].alias("family_priority"), h["priority"].alias("priority"),
        evidence_class(h["rule_id"]).alias("evidence_class"), F.lit("candidate").alias("validation_status"),
        F.lit("none").alias("suppression_status"), F.array().cast("array<string>").alias("reason_codes"),
        h["template"].isNotNull().alias("replacement_template_present")))


def resolved_hits(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["rule_id"].alias("winning_rule_id"), s["category"].alias("category"), s["ptr"].alias("json_pointer"),
        s["st"].alias("st"), s["en"].alias("en"), s["action"].alias("effective_action_hint"),
        s["priority"].alias("effective_score"), s["suppressed"].alias("suppressed_rule_ids"),
        F.array_compact(F.array(
            F.concat(F.lit("priority="), s["priority"].cast("string")), F.concat(F.lit("winner="), s["rule_id"]),
            F.when(F.size(s["suppressed"]) > 0, F.concat(F.lit("suppressed="), F.array_join(s["suppressed"], ","))),
        )).alias("precedence_trace"),
        F.lit("resolved").alias("validation_status"), F.lit("none").alias("suppression_status"),
        F.array(F.concat(F.lit("winner:"), s["rule_id"])).alias("reason_codes")))
