"""The entity model as a second source of hits: which leaves it reads, once per distinct text, and what its spans become."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import leaves as L
from veilframe.functions.arrays import explode_once, pinned
from veilframe.functions.match import spans_sql
from veilframe.operators import ner as N
from veilframe.operators.detect import HIT_TYPE, RANK_MAP
from veilframe.operators.rules import DEFAULT_POLICY, Policy
from veilframe.operators.sanitize import evaluate, with_leaves

#: Place of model hits among the rules of a row: behind all of them.
RULE_SEQ = 1_000_000
MESSAGE = r"^/messages/(\d+)/"


@dataclass(frozen=True)
class EntityProfile:
    """What a profile asks the model for, and whether a failed run blocks its enforced requests."""

    types: tuple[str, ...] = tuple(N.ENTITY_CATEGORY)
    fail_closed: bool = False


@dataclass(frozen=True)
class EntitySettings:
    """Profiles that use the model, and which leaves and spans count.

    ``skip_fields`` and ``exclude`` are patterns of pointer segments and of entity texts that do not
    count, ``strip`` of regions that the model sees as blanks. ``skip_tools_and_system`` leaves out tool
    definitions and system messages of requests whose ``path_class`` is ``llm``.
    """

    profiles: Mapping[str, EntityProfile] = field(default_factory=lambda: {"strict": EntityProfile()})
    threshold: float = N.THRESHOLD
    skip_fields: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    strip: tuple[str, ...] = ()
    skip_tools_and_system: bool = False

    def __post_init__(self) -> None:
        for name, profile in self.profiles.items():
            unknown = set(profile.types) - set(N.ENTITY_CATEGORY)
            if unknown:
                raise ValueError(f"profile '{name}': unknown entity types {sorted(unknown)}")


def _read_leaves(settings: EntitySettings) -> Column:
    """The leaves of a request that the model reads; needs ``leaves`` and ``path_class``."""
    said = F.filter("leaves", lambda x: x["ptr"].rlike(MESSAGE + "role$"))
    roles = F.map_from_entries(F.transform(said, lambda x: F.struct(
        F.regexp_extract(x["ptr"], MESSAGE, 1), F.lower(x["text"]))))

    def wanted(x: Column) -> Column:
        keep = N.is_candidate(x["text"])
        for pattern in settings.skip_fields:
            keep = keep & ~N._any_segment(x["ptr"], pattern)
        if settings.skip_tools_and_system:
            ptr = x["ptr"]
            system = F.coalesce(F.try_element_at(F.col("_roles"), F.regexp_extract(ptr, MESSAGE + "content(?:/|$)", 1)) == "system", F.lit(False))
            tool = (ptr == "/tools") | F.startswith(ptr, F.lit("/tools/"))
            keep = keep & ~((F.col("path_class") == "llm") & (tool | system))
        return keep

    return roles, F.filter("leaves", wanted)


def _hits(settings: EntitySettings, policy: Policy) -> Column:
    """Model spans of one leaf (``ner_spans``, ``text``, ``leaf_seq``, ``ptr``, ``effective_profile``) as hits."""
    types = F.create_map(*[x for p, e in settings.profiles.items() for x in (F.lit(p), F.array(*map(F.lit, e.types)))])
    actions = F.create_map(*[x for p in policy.profiles for c in set(N.ENTITY_CATEGORY.values())
                             for x in (F.lit(f"{p.profile_id}/{c}"), F.lit(p.action_for(c)))])

    def counts(s: Column) -> Column:
        value = F.substring("text", s["st"] + 1, s["en"] - s["st"])
        return (s["st"] < s["en"]) & (s["score"] >= settings.threshold) & F.array_contains(
            F.col("_types"), s["entity"]) & ~N.excluded(value, settings.exclude)

    def hit(s: Column, i: Column) -> Column:
        st, en = N.widened(F.col("text"), s["st"], s["en"])
        category = N.category(s["entity"])
        action = F.element_at(actions, F.concat_ws("/", "effective_profile", category))
        return F.struct(
            F.col("leaf_seq"), F.col("ptr"), F.lit(RULE_SEQ).alias("rule_seq"), i.cast("int").alias("match_seq"),
            N.rule_id(s["entity"], s["lang"]).alias("rule_id"), category.alias("category"), st.cast("int").alias("st"),
            en.cast("int").alias("en"), action.alias("action"), F.element_at(F.expr(RANK_MAP), action).alias("rank"),
            F.lit(N.PRIORITY).alias("priority"), F.lit(None).cast("string").alias("template"))

    found = F.filter(F.coalesce("ner_spans", F.array().cast(N.ENTITY_SPANS)), counts)
    return F.element_at(types, F.col("effective_profile")), F.transform(found, hit).cast(HIT_TYPE)


def with_entities(
    requests: DataFrame, load: Callable[[], Callable[[list[str]], list]], settings: EntitySettings = EntitySettings(), *,
    policy: Policy = DEFAULT_POLICY, payload: str = "payload", processor: L.Processor = L.JSON,
) -> DataFrame:
    """Adds ``entity_hits``, ``ner_degraded`` and ``ner_fail_closed`` to valid requests (see ``split_requests``).

    The leaves of all requests meet the model as one set of distinct texts (``ner.recognize_distinct``),
    and its spans come back to every leaf by row and leaf. A request with any failed text is degraded
    and has no entity hits, one of a fail-closed profile is marked for that too. Requests without
    candidate leaves, with a null payload or of other profiles keep an empty list. Rows are known by a
    128-bit hash of request id, profile and payload, so equal rows share one result.
    """
    dtype = requests.schema[payload].dataType
    text = F.col(payload) if isinstance(dtype, T.StringType) else F.to_json(payload)
    parts = [F.col("request_id"), F.col("effective_profile"), text]
    path = F.col("path_class") if "path_class" in requests.columns else F.lit("direct")
    keyed = requests.drop("_nodes").withColumns({
        "_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit("second"), *reversed(parts))})
    roles, wanted = _read_leaves(settings)
    asked = keyed.filter(F.col("effective_profile").isin(list(settings.profiles))).select(
        "_k1", "_k2", "effective_profile", path.alias("path_class"), F.col(payload).alias("payload"))
    asked = with_leaves(asked, "payload", dtype, processor).withColumn("_roles", roles)
    leaves = explode_once(asked, pinned(wanted), "l", "_k1", "_k2", "effective_profile").select(
        "_k1", "_k2", "effective_profile", "l.leaf_seq", "l.ptr", "l.text")
    seen = leaves.withColumn("_seen", F.col("text"))
    for pattern in settings.strip:
        seen = seen.withColumn("_regions", F.expr(spans_sql("_seen", pattern))).withColumn(
            "_seen", N.blank_regions(F.col("_seen"), F.col("_regions")))
    types, hits = _hits(settings, policy)
    found = N.recognize_distinct(seen, "_seen", load).withColumn("_types", types).select(
        "_k1", "_k2", F.struct("leaf_seq", hits.alias("hits")).alias("leaf"), (F.col("status") != "ok").alias("failed"))
    rows = found.groupBy("_k1", "_k2").agg(F.array_sort(F.collect_set("leaf")).alias("_leaves"), F.max("failed").alias("_failed"))
    closed = [p for p, e in settings.profiles.items() if e.fail_closed]
    none = F.array().cast(HIT_TYPE)
    return keyed.join(rows, ["_k1", "_k2"], "left").withColumns({
        "ner_degraded": F.coalesce("_failed", F.lit(False)),
        "entity_hits": F.when(F.coalesce("_failed", F.lit(False)), none).otherwise(
            F.coalesce(F.flatten(F.transform("_leaves", lambda x: x["hits"])), none)),
    }).withColumn("ner_fail_closed", F.col("ner_degraded") & F.col("effective_profile").isin(closed)).drop(
        "_k1", "_k2", "_leaves", "_failed")


def evaluate_with_entities(
    requests: DataFrame, load: Callable[[], Callable[[list[str]], list]], settings: EntitySettings = EntitySettings(), *,
    policy: Policy = DEFAULT_POLICY, payload: str = "payload", processor: L.Processor = L.JSON, **options,
) -> DataFrame:
    """``sanitize.evaluate`` with the model's hits beside the rules', and its failures as degraded or blocked rows."""
    found = with_entities(requests, load, settings, policy=policy, payload=payload, processor=processor)
    return evaluate(found, policy=policy, payload=payload, processor=processor, extra_hits="entity_hits", degraded="ner_degraded",
                    fail_closed="ner_fail_closed", **options).drop("entity_hits", "ner_degraded", "ner_fail_closed")
