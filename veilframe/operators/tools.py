"""Tool-call compliance: who may call what, and whether the arguments are acceptable.

Policies are tables. Calls meet them in equi-joins on (server, tool); Spark broadcasts a policy table
only when its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.leaves import json_depth, json_nodes

DEAD = r"(?U)^\s*$"  # a text of white space only


def call_reason(calls: DataFrame, servers: DataFrame, tools: DataFrame) -> DataFrame:
    """Adds ``reason``: the first check that fails, in order, or ``allowed``, and the tool's policy."""
    live = servers.filter("enabled").select(F.col("id").alias("server"), "allowed", "blocked")
    joined = calls.join(live, "server", "left").join(
        tools.withColumnRenamed("enabled", "tool_enabled"), ["server", "tool"], "left")
    reason = (
        F.when(F.col("allowed").isNull(), "server_not_allowlisted")
        .when(F.array_contains("blocked", F.col("tool")), "tool_blocklisted")
        .when(~F.array_contains("allowed", F.col("tool")), "tool_not_allowlisted")
        .when(~F.col("tool_enabled"), "tool_blocklisted")
        .otherwise("allowed")
    )
    return joined.withColumn("reason", reason)


def shape_error(server: Column, tool: Column, arguments: Column) -> Column:
    return (
        F.when(server.rlike(DEAD), "server_empty").when(tool.rlike(DEAD), "tool_empty")
        .when(F.json_object_keys(arguments).isNull(), "arguments_not_object")
    )


def pilot_error(tags: Column) -> Column:
    """Only ``transport=http_json`` and ``variant=tool_call`` are supported, where present."""
    return (
        F.when(F.try_element_at(tags, F.lit("transport")) != "http_json", "unsupported_transport")
        .when(F.try_element_at(tags, F.lit("variant")) != "tool_call", "unsupported_variant")
    )


def path_segments(path: Column) -> Column:
    """Normalised segments of a relative path; null when absolute, on a drive, or escaping upwards."""
    none = F.lit(None).cast("array<string>")
    parts = F.filter(F.split(path, r"[/\\]"), lambda s: (s != "") & (s != "."))

    def step(acc, s):
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(none)
        return F.when(acc.isNull(), none).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"^(?:[/\\]|[A-Za-z]:)"), none).otherwise(folded)


def path_allowed(path: Column, prefixes: Column) -> Column:
    segments = path_segments(path)

    def fits(prefix):
        want = path_segments(prefix)
        return F.coalesce((F.size(want) > 0) & (F.slice(segments, F.lit(1), F.size(want)) == want), F.lit(False))

    return F.when(segments.isNull(), False).otherwise(F.exists(prefixes, fits))


def _type_ok(kind: Column, wanted: Column) -> Column:
    return F.when(wanted == "number", kind.isin("integer", "number")).when(
        wanted.isin("object", "array", "string", "integer", "boolean", "null"), kind == wanted).otherwise(True)


def argument_violations(calls: DataFrame, max_long: int | None = None) -> DataFrame:
    """Adds ``schema_violations`` and ``constraint_violations``; schema problems hide the latter.

    Expects the policy columns of ``call_reason`` on each call. Both are null where the arguments are no
    object, which ``shape_error`` reports. ``max_long`` ends the count of long strings early.
    """
    df = calls.withColumn("_nodes", json_nodes(F.col("arguments")))
    df = df.withColumn("_keys", F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>")))
    top = F.map_from_entries(F.array_distinct(F.transform("_nodes", lambda n: F.struct(
        F.replace(F.replace(F.split_part(n["ptr"], F.lit("/"), F.lit(2)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("k"),
        n["top"].alias("v")))))
    df = df.withColumn("_kinds", top)
    spec = F.from_json("schema", "type string, required array<string>, properties map<string,struct<type:string>>, additionalProperties boolean")
    df = df.withColumn("_spec", spec)
    props = F.coalesce(F.map_entries("_spec.properties"), F.array().cast("array<struct<key:string,value:struct<type:string>>>"))
    empty = F.array().cast("array<string>")
    root = F.when(F.coalesce(F.col("_spec.type"), F.lit("object")).isin("array", "string", "integer", "number", "boolean", "null"), 1).otherwise(0)
    missing = F.size(F.filter(F.coalesce("_spec.required", empty), lambda k: ~F.array_contains("_keys", k)))
    wrong = F.size(F.filter(props, lambda p: F.array_contains("_keys", p["key"]) & p["value"]["type"].isNotNull() & ~_type_ok(
        F.try_element_at("_kinds", p["key"]), p["value"]["type"])))
    known = F.coalesce(F.map_keys("_spec.properties"), empty)
    extra = F.when(F.col("_spec.additionalProperties") == F.lit(False), F.size(F.array_except("_keys", known))).otherwise(0)
    an_object = F.json_object_keys("arguments").isNotNull()
    df = df.withColumn("schema_violations", F.when(an_object, F.when(F.col("_spec").isNull(), 0).otherwise(
        root + missing + wrong + extra)))

    def size_of(arr):
        return F.coalesce(F.size(arr), F.lit(0))

    keys = size_of(F.array_except(F.coalesce("required", empty), "_keys")) + size_of(
        F.array_intersect(F.coalesce("forbidden", empty), "_keys"))
    deep = F.when(json_depth(F.col("_nodes")) > F.col("max_depth"), 1).otherwise(0)
    longs = size_of(F.filter("_nodes", lambda n: (n["kind"] == "string") & (F.octet_length(n["text"]) > F.col("max_string_length"))))
    longs = F.when(F.col("max_string_length").isNull(), 0).otherwise(
        longs if max_long is None else F.least(longs, F.greatest(F.lit(0), F.lit(max_long) - keys - deep)))
    is_path = lambda n: (n["key"] == "path") | F.endswith(n["key"], F.lit("_path"))
    paths = F.when(F.size(F.coalesce("path_prefixes", empty)) > 0, size_of(F.filter(
        "_nodes", lambda n: (n["kind"] == "string") & F.coalesce(is_path(n), F.lit(False)) & ~path_allowed(
            n["text"], F.col("path_prefixes"))))).otherwise(0)
    df = df.withColumn("_constraints", keys + deep + longs + paths)
    return df.withColumn("constraint_violations", F.when(an_object, F.when(F.col("schema_violations") > 0, 0).otherwise(
        F.col("_constraints")))).drop("_nodes", "_keys", "_kinds", "_spec", "_constraints")


def result_envelope(payload: Column) -> Column:
    """Content, content type, whether it was cut, and error of a tool result.

    An object in ``result`` is the envelope and must have content; else the object's own ``content``
    counts, else the whole value.
    """
    inner = F.get_json_object(payload, "$.result")
    nested = F.json_object_keys(inner).isNotNull()
    held = F.array_contains(F.json_object_keys(inner), F.lit("content"))
    source = F.when(nested, inner).otherwise(F.when(F.json_object_keys(payload).isNotNull(), payload))
    own = F.coalesce(F.array_contains(F.json_object_keys(payload), F.lit("content")), F.lit(False))
    variant = F.try_parse_json(source)
    return F.struct(
        F.when(nested, F.get_json_object(inner, "$.content")).when(own, F.get_json_object(payload, "$.content")).otherwise(
            payload).alias("content"),
        F.when(F.schema_of_variant(F.try_variant_get(variant, "$.content_type", "variant")) == "STRING",
               F.try_variant_get(variant, "$.content_type", "string")).alias("content_type"),
        F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(variant, "$.truncated", "variant")) == "BOOLEAN",
                          F.try_variant_get(variant, "$.truncated", "boolean")), F.lit(False)).alias("truncated"),
        F.when(nested & ~held, "result.content required").alias("error"))


def rejection(calls: DataFrame) -> DataFrame:
    """Adds ``error``, the first of the shape, pilot and profile failures, and ``rejected``."""
    other = F.when(F.col("meta_profile") != F.col("key_profile"), "profile_mismatch")
    error = F.coalesce(shape_error(F.col("server"), F.col("tool"), F.col("arguments")), pilot_error(F.col("tags")), other)
    return calls.withColumn("error", error).withColumn("rejected", F.col("error").isNotNull())


def audit_row(df: DataFrame) -> DataFrame:
    """One metadata-only record per call.

    A call that fails its shape, the pilot subset or its profile binding (``rejected``, where that column
    exists) has action ``block`` without being blocked by policy; policy and argument failures are blocked.
    """
    rejected = F.col("rejected") if "rejected" in df.columns else F.lit(False)
    blocked = ~rejected & ((F.col("reason") != "allowed") | F.coalesce(
        F.col("schema_violations") + F.col("constraint_violations") > 0, F.lit(False)))
    return df.select(
        "request_id", F.col("server").alias("server_id"), F.col("tool").alias("tool_id"), "profile_id",
        F.when(blocked | rejected, "block").otherwise("allow").alias("final_action"), F.lit(0).cast("bigint").alias("rule_hits_total"),
        blocked.alias("blocked"))


def audit_calls(calls: DataFrame, servers: DataFrame, tools: DataFrame) -> DataFrame:
    """The whole chain: policy reason, shape, subset and profile binding, arguments; one audit record per call.

    ``calls`` has ``request_id, server, tool, arguments, tags, meta_profile, key_profile``.
    """
    checked = argument_violations(call_reason(calls, servers, tools))
    return audit_row(rejection(checked).withColumn("profile_id", F.col("key_profile")))
