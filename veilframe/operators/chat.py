"""Chat requests and responses: validation, routing, identity, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.events import EVENTS
from veilframe.operators.sanitize import evaluate

# Roles, known profiles, default stream buffer limit.
ROLES = ("system", "user", "assistant", "tool")
KNOWN_PROFILES = ("minimal", "strict", "custom")
MAX_BUFFER_BYTES = 1048576
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MESSAGES = "array<variant>"


def _kind(variant: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ... of a variant; null when absent."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def _text(variant: Column, path: str) -> Column:
    """A string value at ``path``; other types give null."""
    inner = F.try_variant_get(variant, path, "variant")
    return F.when(_kind(inner) == "STRING", F.try_variant_get(variant, path, "string"))


def _filled(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def validate(df: DataFrame, body: str) -> DataFrame:
    """Adds ``error``: the first problem of a chat body, null when it is well formed.

    Messages are checked in order; an error names the index of the first bad one.
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(body)))
    messages = F.try_variant_get("_v", "$.messages", MESSAGES)

    def bad_block(b):
        return (_kind(b) != "OBJECT") | ~_filled(_text(b, "$.type"))

    def problem(m, i):
        at = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
        content = F.try_variant_get(m, "$.content", "variant")
        role = F.trim(_text(m, "$.role"))
        blocks = F.try_variant_get(m, "$.content", MESSAGES)
        return (
            F.when(_kind(m) != "OBJECT", F.concat(at, F.lit(" not an object")))
            .when(~_filled(role), F.concat(at, F.lit(".role required")))
            .when(~role.isin(*ROLES), F.concat(at, F.lit(".role unknown")))
            .when(content.isNull(), F.concat(at, F.lit(".content required")))
            .when(~_kind(content).isin("STRING", "ARRAY"), F.concat(at, F.lit(".content unsupported")))
            .when((_kind(content) == "ARRAY") & F.exists(F.coalesce(blocks, F.expr("array()").cast(MESSAGES)), bad_block),
                  F.concat(at, F.lit(".content block invalid")))
        )

    df = df.withColumn("_m", messages).withColumn("_p", F.array_compact(F.transform("_m", problem)))
    error = (
        F.when(F.col("_v").isNull() | (_kind(F.col("_v")) != "OBJECT"), "body not an object")
        .when(~_filled(_text(F.col("_v"), "$.model")), "model required")
        .when(F.try_variant_get("_v", "$.messages", "variant").isNull(), "messages required")
        .when(F.col("_m").isNull(), "messages not an array")
        .when(F.size("_m") == 0, "messages empty")
        .otherwise(F.try_element_at("_p", F.lit(1)))
    )
    return df.withColumn("error", error).drop("_v", "_m", "_p")


def responses_input(df: DataFrame, body: str) -> DataFrame:
    """Adds ``error`` and ``messages`` for responses bodies.

    A text, a message or a list of both becomes ``array<struct<role,content,blocks>>``: ``content`` is the text of
    a message, ``blocks`` the JSON of content that is a list. ``error`` is the first problem in order,
    with the index of the item it is about; then there are no messages.
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(body)))
    value = F.try_variant_get("_v", "$.input", "variant")
    item = "struct<v: variant, role: string, kind: string>"

    def read(m: Column) -> Column:
        return F.struct(m.alias("v"), F.trim(_text(m, "$.role")).alias("role"),
                        _kind(F.try_variant_get(m, "$.content", "variant")).alias("kind"))

    items = F.when(_kind(value) == "ARRAY", F.try_variant_get("_v", "$.input", MESSAGES)).when(
        _kind(value).isin("STRING", "OBJECT"), F.array(value))
    df = df.withColumn("_items", F.transform(items, read).cast(f"array<{item}>")).withColumn("_kind", _kind(value))

    def problem(x: Column, i: Column) -> Column:
        at = F.when(F.col("_kind") == "ARRAY", F.concat(F.lit("input["), i.cast("string"), F.lit("]"))).otherwise("input")
        return (
            F.when(_kind(x["v"]) == "STRING", F.lit(None).cast("string"))
            .when(F.coalesce(_kind(x["v"]) != "OBJECT", F.lit(True)), F.concat(at, F.lit(" unsupported")))
            .when(~_filled(x["role"]), F.concat(at, F.lit(".role required")))
            .when(x["kind"].isNull(), F.concat(at, F.lit(".content required")))
            .when(~x["kind"].isin("STRING", "ARRAY"), F.concat(at, F.lit(".content unsupported"))))

    def message(x: Column) -> Column:
        plain = _kind(x["v"]) == "STRING"
        blocks = F.when(x["kind"] == "ARRAY", F.to_json(F.try_variant_get(x["v"], "$.content", "variant")))
        return F.struct(F.when(plain, "user").otherwise(x["role"]).alias("role"), F.when(plain, F.try_variant_get(
            x["v"], "$", "string")).otherwise(_text(x["v"], "$.content")).alias("content"), blocks.alias("blocks"))

    error = (
        F.when(F.col("_v").isNull() | (_kind(F.col("_v")) != "OBJECT"), "body not an object")
        .when(~_filled(_text(F.col("_v"), "$.model")), "model required")
        .when(F.try_variant_get("_v", "$.input", "variant").isNull(), "input required")
        .when(F.col("_items").isNull(), "input unsupported")
        .when(F.size("_items") == 0, "input empty")
        .otherwise(F.try_element_at(F.array_compact(F.transform("_items", problem)), F.lit(1))))
    return df.withColumn("error", error).withColumn("messages", F.when(F.col("error").isNull(), F.transform(
        "_items", message))).drop("_v", "_items", "_kind")


def masked_streams(streams: DataFrame, body: str = "body", **options) -> DataFrame:
    """Event-stream bodies through ``evaluate``, rebuilt in order; one row per stream, without a shuffle.

    Needs the columns of valid requests (see ``split_requests``). Hits of all events add up, the strictest
    action counts, and a stream with a blocked event has a null ``sanitized_payload``. A hit limit
    of the profile counts for the whole stream.
    """
    return evaluate(streams, payload=body, processor=EVENTS, **options)


def metadata_tags(body: Column) -> Column:
    """String entries of ``metadata``; other types are ignored."""
    raw = F.try_variant_get(F.try_parse_json(body), "$.metadata", "map<string,variant>")
    strings = F.map_filter(raw, lambda k, v: _kind(v) == "STRING")
    return F.coalesce(F.transform_values(strings, lambda k, v: F.try_variant_get(v, "$", "string")),
                      F.expr("cast(map() as map<string,string>)"))


def effective_profile(hint: Column, provider: Column, key: Column, default: Column) -> Column:
    def known(c):
        return F.when(F.trim(c).isin(*KNOWN_PROFILES), F.trim(c))

    return F.coalesce(known(hint), known(provider), F.when(key.isin(*KNOWN_PROFILES), key), default)


def model_key(model: Column) -> Column:
    """Trimmed, ASCII lower case only."""
    return F.translate(F.trim(model), UPPER, LOWER)


def route_keys(routes: DataFrame, providers: DataFrame) -> DataFrame:
    """Every key a model can be asked for: canonical names and aliases of live routes."""
    live = routes.filter("enabled").join(providers.filter("enabled").select(F.col("id").alias("provider_id"), "profile_id"), "provider_id")
    names = F.concat(
        F.array(F.struct(F.col("model").alias("id"), F.lit(False).alias("via_alias"))),
        F.transform("aliases", lambda a: F.struct(a.alias("id"), F.lit(True).alias("via_alias"))))
    return live.select("provider_id", "profile_id", "output_sanitization", F.col("model").alias("canonical_model"), F.inline(names)).withColumn(
        "key", model_key(F.col("id")))


def key_conflicts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("routes")).filter((F.col("routes") > 1) | (F.col("key") == ""))


def route(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds provider, canonical model and ``error`` for unknown models."""
    out = requests.withColumn("key", model_key(F.col("model"))).join(keys.drop("id"), "key", "left")
    return out.withColumn("error", F.when(F.col("canonical_model").isNull(), "model_not_routed"))


def fingerprint(token: Column) -> Column:
    return F.concat(F.lit("gw_"), F.substring(F.sha2(token, 256), 1, 32))


def sse_lines(bodies: DataFrame, body: str) -> DataFrame:
    """One row per line of each event: ``event_pos, line_pos, line, kind, data``."""
    events = bodies.select("*", F.posexplode(F.split(body, "\n\n")).alias("event_pos", "_event")).filter("trim(_event) <> ''")
    lines = events.select("*", F.posexplode(F.split("_event", "\r?\n")).alias("line_pos", "line")).drop("_event", body)
    data = F.trim(F.substring(F.col("line"), F.lit(6), F.char_length("line")))
    kind = (
        F.when(~F.startswith("line", F.lit("data:")), "other").when(data == "[DONE]", "done")
        .when(F.try_parse_json(data).isNull(), "not_json").otherwise("json"))
    return lines.withColumn("kind", kind).withColumn("data", F.when(F.startswith("line", F.lit("data:")), data))


def text_delta(data: Column) -> Column:
    """The text deltas of all choices, joined."""
    choices = F.from_json(F.get_json_object(data, "$.choices"), "array<struct<delta:struct<content:string>>>")
    return F.array_join(F.transform(choices, lambda c: F.coalesce(c["delta"]["content"], F.lit(""))), "")


def over_limit(chunks: DataFrame, limit: int = MAX_BUFFER_BYTES) -> DataFrame:
    """Streams whose bytes exceed the buffer; totals are pre-aggregated per stream."""
    return chunks.groupBy("stream_id").agg(F.sum(F.octet_length("chunk")).alias("bytes")).filter(F.col("bytes") > limit)


def outcome(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Input and output decisions of a request: strictest action, hits summed."""
    both = inputs.select("request_id", "final_action", "rank", "hits").unionByName(outputs.select("request_id", "final_action", "rank", "hits"))
    return both.groupBy("request_id").agg(F.max_by("final_action", "rank").alias("final_action"), F.sum("hits").alias("hits"))


def error_digest(body: Column) -> Column:
    """What an upstream error says about itself, without its message."""
    root = F.coalesce(F.get_json_object(body, "$.error"), body)

    def first(names, *sources):
        return F.coalesce(*[F.when(F.trim(F.get_json_object(s, f"$.{n}")) != "", F.get_json_object(s, f"$.{n}")) for s in sources for n in names])

    message = first(("message", "error_description", "detail"), root, body)
    return F.struct(
        first(("type", "error_type", "reason"), root, body).alias("error_type"),
        F.coalesce(first(("code", "error_code"), root), first(("code", "error_code", "status"), body)).alias("error_code"),
        first(("param", "error_param", "field"), root, body).alias("error_param"),
        F.octet_length(message).cast("bigint").alias("message_bytes"),
        F.array_join(F.array_sort(F.json_object_keys(root)), ",").alias("keys"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """All stream bodies in chunk order; ``over_limit`` reports those above a buffer limit.

    A stream is one value and so lies in one task; its size bounds that task.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("stream_id").agg(
        F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias("body"))


def stream_outcome(events: DataFrame, key: str) -> DataFrame:
    """Per stream: hits of all events, strictest action, blocked when any event blocks."""
    return events.groupBy(key).agg(F.sum("hits").alias("hits"), F.max_by("final_action", "rank").alias("final_action"))
