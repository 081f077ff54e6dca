"""The whole job, one row per request, in one narrow stage.

leaves -> hits -> spans -> decision -> masked value -> explain and audit. Nothing shuffles; each
stage is its own column so later ones read it instead of computing it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import leaves as L
from veilframe.functions.arrays import pinned
from veilframe.functions.fragments import apply_spans
from veilframe.functions.match import exact_key_sql, lit
from veilframe.operators import decide as D
from veilframe.operators.detect import RANK_MAP, leaf_hits_sql, no_hits
from veilframe.operators.resolve import final_action, resolve_in_row
from veilframe.operators.rules import ACTIONS, CATEGORIES, DEFAULT_POLICY, Policy

BLOCK = ACTIONS[-1]


def _with_allow_keys(df: DataFrame, allowlist: str | None) -> tuple[DataFrame, str | None]:
    """The request allowlist, folded once per row."""
    if allowlist is None:
        return df, None
    keys = f"coalesce(transform(`{allowlist}`, a -> {exact_key_sql('a')}), cast(array() as array<string>))"
    return df.withColumn("_allow", F.expr(keys)), "_allow"


def _capped(hits: Column, limit: Column | int | None) -> Column:
    """The first hits up to the profile's limit, where it sets one; see ``_dropped`` for the others."""
    limit = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    return F.when(F.size(hits) > limit, F.slice(hits, F.lit(1), limit)).otherwise(hits)


def _dropped(hits: Column, limit: Column | int | None) -> Column:
    """How many hits a limit left out; a row with any is blocked."""
    limit = limit if isinstance(limit, Column) else F.lit(limit).cast("int")
    return F.coalesce(F.greatest(F.size(hits) - limit, F.lit(0)), F.lit(0))


def blank(text: Column) -> Column:
    """Null, empty, or white space of any kind only."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def detect_text(
    df: DataFrame, column: str, *, policy: Policy = DEFAULT_POLICY, profile: str | None = None,
    ptr: str = "/content", allowlist: str | None = None,
) -> DataFrame:
    """Adds ``hits`` for a plain text column seen as one leaf at ``ptr``, and how many a limit dropped."""
    profile = profile or policy.default_profile
    staged, allow = _with_allow_keys(df.withColumn("_low", F.lower(F.col(column))), allowlist)
    hits = F.expr(leaf_hits_sql(
        policy, "0", lit(ptr), f"`{column}`", "_low", profile_id=profile, allow=allow, static_ptr=ptr))
    hits = F.when(F.col(column).isNotNull(), hits).otherwise(no_hits())
    return staged.withColumn("_raw", pinned(hits)).withColumn(
        "hits", _capped(F.col("_raw"), policy.by_id[profile].max_hits)).withColumn(
        "dropped_hits", _dropped(F.col("_raw"), policy.by_id[profile].max_hits)).drop("_low", "_raw", "_allow")


def resolve(df: DataFrame) -> DataFrame:
    """Adds ``spans`` and ``final_action`` from ``hits``."""
    return df.withColumn("spans", pinned(resolve_in_row(F.col("hits")))).withColumn(
        "final_action", final_action(F.col("spans")))


def sanitize_text(
    df: DataFrame, column: str, *, policy: Policy = DEFAULT_POLICY, profile: str | None = None,
    ptr: str = "/content", allowlist: str | None = None, output: str = "sanitized_text",
) -> DataFrame:
    """Detect, resolve and mask one text column; blocked rows get a null text.

    Filter rows before this: a later filter does not reach below the detection.
    """
    profile = profile or policy.default_profile
    out = resolve(detect_text(df, column, policy=policy, profile=profile, ptr=ptr, allowlist=allowlist))
    visible = policy.by_id[profile].mask_visible_suffix
    out = out.withColumn("final_action", F.when(F.col("dropped_hits") > 0, BLOCK).otherwise(F.col("final_action")))
    blocked = F.col("final_action") == BLOCK
    masked = F.when(~blocked, apply_spans(F.col(column), F.col("spans"), visible))
    return out.withColumn("blocked", blocked).withColumn(output, pinned(masked)).withColumn(
        "transformed_fields",
        F.when(~blocked & (F.col(output) != F.col(column)), 1).otherwise(0))


def with_leaves(df: DataFrame, payload: str, dtype: T.DataType | None = None, processor: L.Processor = L.JSON) -> DataFrame:
    """Adds ``leaves``: typed columns are walked by schema, strings are read by the processor, as JSON by default.

    Where ``split_requests`` has read the payload already, its column ``_nodes`` is used up.
    """
    dtype = dtype or df.schema[payload].dataType
    if isinstance(dtype, T.StringType):
        read = df if "_nodes" in df.columns else df.withColumn("_nodes", processor.nodes(F.col(payload)))
        return read.withColumn("leaves", L.string_leaves(F.col("_nodes"))).drop("_nodes")
    return df.withColumn("leaves", L.typed_leaves(F.col(payload), dtype))


def split_requests(df: DataFrame, policy: Policy = DEFAULT_POLICY, payload: str = "payload",
                   processor: L.Processor = L.JSON) -> tuple[DataFrame, DataFrame]:
    """Valid requests with ``effective_profile``, and rejected ones with ``error``.

    Valid ones keep what was read of a text payload in ``_nodes``, so that ``evaluate`` does not read it again.

    ``request_id`` and ``effective_language`` must not be blank; a blank profile means the default
    and an unknown one is an error. So is a text payload that is not JSON, or too deep to parse.
    """
    known = [p.profile_id for p in policy.profiles]
    effective = F.when(blank(F.col("profile_id")), F.lit(policy.default_profile)).otherwise(F.col("profile_id"))
    error = (
        F.when(blank(F.col("request_id")), "invalid_input:request_id")
        .when(blank(F.col("effective_language")), "invalid_input:effective_language")
        .when(~effective.isin(known), F.concat(F.lit("invalid_profile:"), effective))
    )
    checked = df.withColumn("effective_profile", effective).withColumn("error", error)
    if payload in df.columns and isinstance(df.schema[payload].dataType, T.StringType):
        checked = checked.withColumn("_nodes", processor.nodes(F.col(payload))).withColumn("error", F.coalesce(
            "error", F.when(F.col("_nodes").isNull(), "invalid_input:payload")))
    return checked.filter("error is null").drop("error"), checked.filter("error is not null").drop("_nodes")


def _by_profile(policy: Policy, value) -> Column:
    pairs = [x for p in policy.profiles for x in (F.lit(p.profile_id), F.lit(value(p)))]
    return F.element_at(F.create_map(*pairs), F.col("effective_profile"))


def evaluate(
    requests: DataFrame, *, policy: Policy = DEFAULT_POLICY, payload: str = "payload",
    extra_hits: str | None = None, degraded: str | None = None, fail_closed: str | None = None,
    protect: str | None = None, trace: bool = False, processor: L.Processor = L.JSON,
) -> DataFrame:
    """Evaluate valid requests (see ``split_requests``), each under its own profile and mode.

    ``extra_hits`` names a column of hits from other recognizers; they follow the detected ones and
    do not count against the hit limit. ``degraded`` and ``fail_closed`` are flags from the
    recognizer run: a fail-closed row is blocked when its mode enforces. ``protect`` is a pointer
    prefix whose leaves are scanned but never rewritten. A text payload that does not parse, and a row
    with more hits than an explicit limit, are blocked: nothing unscanned is released. ``trace`` keeps the stage columns.
    ``processor`` reads and writes text payloads that are not JSON.
    """
    dtype = requests.schema[payload].dataType
    df = with_leaves(requests, payload, dtype, processor)
    df = df.withColumn("_leaves", F.transform("leaves", lambda x: F.struct(
        x["leaf_seq"].alias("leaf_seq"), x["ptr"].alias("ptr"), x["text"].alias("text"),
        F.lower(x["text"]).alias("low"))))
    df = df.withColumns({
        **{f"_act_{c}": _by_profile(policy, lambda p, c=c: p.action_for(c)) for c in CATEGORIES},
        "_limit": _by_profile(policy, lambda p: p.max_hits),
        "_visible": _by_profile(policy, lambda p: p.mask_visible_suffix)})
    df, allow = _with_allow_keys(df, "allowlist" if "allowlist" in requests.columns else None)

    per_leaf = leaf_hits_sql(
        policy, "x.leaf_seq", "x.ptr", "x.text", "x.low", profile_col="effective_profile",
        actions={c: (f"_act_{c}", f"element_at({RANK_MAP}, _act_{c})") for c in CATEGORIES}, allow=allow)
    hits = F.expr(f"flatten(transform(_leaves, x -> {per_leaf}))")
    df = df.withColumn("_raw", pinned(F.coalesce(hits, no_hits()))).withColumn(
        "_own", _capped(F.col("_raw"), F.col("_limit")))
    df = df.withColumn("hits", F.concat(F.col("_own"), F.coalesce(F.col(extra_hits), no_hits()))
                       if extra_hits else F.col("_own"))
    df = df.withColumn("spans", pinned(resolve_in_row(F.col("hits"))))

    enabled = D.execution_enabled(F.col("mode"))
    is_degraded = F.coalesce(F.col(degraded), F.lit(False)) if degraded else F.lit(False)
    closed = (F.coalesce(F.col(fail_closed), F.lit(False)) & enabled) if fail_closed else F.lit(False)
    df = df.withColumn("execution_enabled", enabled).withColumn("is_degraded", is_degraded).withColumn(
        "fail_closed_applied", closed)
    unread = F.col("leaves").isNull() if isinstance(dtype, T.StringType) else F.lit(False)
    cut = _dropped(F.col("_raw"), F.col("_limit")) > 0
    df = df.withColumn("final_action", F.when(F.col("fail_closed_applied") | unread | cut, BLOCK).otherwise(
        final_action(F.col("spans")))).withColumn("blocked", F.col("final_action") == BLOCK)
    df = _rewrite(df, payload, dtype, protect, processor)
    df = _decision(df)
    keep = [c for c in requests.columns if c not in (payload, "_nodes")] + ([payload] if trace else [])
    cols = [*keep, "final_action", "blocked", "sanitized_payload", "transformed_fields", "decision",
            "explain", "audit", "executed", "degraded"]
    if trace:
        df = df.withColumn("trace", F.struct(
            D.normalized_hits(F.col("hits")).alias("normalized_hits"),
            D.resolved_hits(F.col("spans")).alias("resolved_hits"),
            D.transform_plan(F.col("spans"), F.col("final_action"), F.col("mode"), F.col("_visible")).alias("plan")))
        cols += ["hits", "spans", "leaves", "trace"]
    return df.select(*cols)


def _rewrite(df: DataFrame, payload: str, dtype: T.DataType, protect: str | None, processor: L.Processor) -> DataFrame:
    """Adds ``sanitized_payload`` (null when blocked) and the number of leaves that changed."""
    def changed(x):
        mine = F.filter("spans", lambda s: s["ptr"] == x["ptr"])
        new = apply_spans(x["text"], mine, F.col("_visible"))
        if protect is not None:
            guarded = (x["ptr"] == protect) | F.startswith(x["ptr"], F.lit(protect + "/"))
            new = F.when(guarded, x["text"]).otherwise(new)
        return F.struct(x["ptr"].alias("ptr"), x["text"].alias("old"), new.alias("new"))

    touched = F.filter("_leaves", lambda x: F.exists("spans", lambda s: s["ptr"] == x["ptr"]))
    diffs = F.filter(F.transform(touched, changed), lambda d: d["old"] != d["new"])
    none = F.array().cast("array<struct<ptr:string,old:string,new:string>>")
    df = df.withColumn("_diff", pinned(F.when(F.col("blocked"), none).otherwise(F.coalesce(diffs, none))))
    df = df.withColumn("transformed_fields", F.size("_diff"))
    texts = F.map_from_entries(F.transform("_diff", lambda d: F.struct(d["ptr"], d["new"])))
    if isinstance(dtype, T.StringType):
        new = processor.rewrite(F.col(payload), texts)
    else:
        new = L.rewrite_typed(F.col(payload), dtype, F.col("_texts"))
        df = df.withColumn("_texts", texts)
    return df.withColumn("_new", new).withColumn("sanitized_payload", F.when(~F.col("blocked"), F.col("_new")))


def _decision(df: DataFrame) -> DataFrame:
    hits, spans = F.col("hits"), F.col("spans")
    codes = D.winner_codes(spans)
    closed = F.col("fail_closed_applied")
    marker = F.array(F.lit("winner:fail_closed.ner_inference"))
    df = df.withColumn("_codes", F.when(closed, F.array_union(codes, marker)).otherwise(codes))
    df = df.withColumn("_cat", D.hits_by_category(hits)).withColumn("_fam", D.hits_by_family(hits, spans))
    lang = F.col("effective_language") if "effective_language" in df.columns else F.lit("")
    allow = F.col("allowlist") if "allowlist" in df.columns else F.array().cast("array<string>")
    path = F.col("path_class") if "path_class" in df.columns else F.lit("direct")
    df = df.withColumn("decision", F.struct(
        F.col("final_action"), F.size(hits).alias("rule_hits_total"),
        D.deterministic_candidates(hits).alias("deterministic_candidates_total"),
        D.suppressed_total(spans).alias("suppressed_candidates_total"),
        F.col("_cat").alias("hits_by_category"), F.col("_fam").alias("hits_by_family"),
        F.col("_codes").alias("reason_codes"), D.locations(spans).alias("resolved_locations"),
        D.replay_identity(spans, F.col("effective_profile"), F.col("mode"), path, lang, allow).alias("replay_identity")))
    df = df.withColumn("executed", F.struct(
        F.col("execution_enabled"), F.array(*[F.lit(s) for s in D.STAGES]).alias("stages_completed"),
        (F.col("transformed_fields") > 0).alias("transform_applied"),
        D.transform_metadata(F.col("blocked"), F.col("transformed_fields")).alias("transform_metadata")))
    df = df.withColumn("degraded", F.struct("is_degraded", "fail_closed_applied"))
    df = df.withColumn("explain", F.struct(
        F.col("effective_profile").alias("profile_id"), F.col("mode"), F.col("final_action"),
        D.explain_categories(hits, spans).alias("categories"), F.size(hits).alias("rule_hits_total"),
        F.col("_fam").alias("family_counts"), F.col("_cat").alias("entity_counts"),
        D.explain_codes(spans, F.col("_codes")).alias("reason_codes"),
        F.array().cast("array<string>").alias("confidence_buckets"), D.provenance(spans).alias("provenance_summary"),
        D.degradation_markers(F.col("execution_enabled"), F.col("is_degraded"), closed).alias("degradation_markers")))
    return df.withColumn("audit", F.struct(
        F.col("request_id"), F.col("effective_profile").alias("profile_id"), F.col("mode"), F.col("final_action"),
        F.size(hits).alias("rule_hits_total"), F.col("_cat").alias("hits_by_category"),
        F.col("_fam").alias("counts_by_family"), F.lit(None).cast("bigint").alias("duration_ms"),
        path.alias("path_class"),
        D.degradation_metadata(F.col("execution_enabled"), F.col("is_degraded"), closed).alias("degradation_metadata")))


def families_executed(policy: Policy, profile: str, ner: bool = False) -> list[str]:
    """Which recognizer families a profile's rules make a run execute."""
    ids = [r.rule_id for r in policy.by_id[profile].configured_rules()]
    out = ["builtin"]
    out += [f for f in ("deterministic", "custom") if any(i.startswith(f + ".") for i in ids)]
    return out + (["ner"] if ner else [])
