"""Detection: leaves in, hits out, all inside one projection.

A hit never carries the matched text. Rules are expanded into literal expressions so patterns
compile once per task, and every rule sits behind its pointer gate and its guard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import match as M
from veilframe.functions.match import lit
from veilframe.operators.rules import BUILTIN_RULES, MAX_CONTEXT_SCORE, RANK, Policy, Rule

HIT_FIELDS = (
    "leaf_seq:int,ptr:string,rule_seq:int,match_seq:int,rule_id:string,category:string,"
    "st:int,en:int,action:string,rank:int,priority:int,template:string"
)
HIT_TYPE = f"array<struct<{HIT_FIELDS}>>"
NO_HITS = f"cast(array() as {HIT_TYPE})"
RANK_MAP = "map(" + ", ".join(f"{lit(a)}, {r}" for a, r in RANK.items()) + ")"


def no_hits() -> Column:
    return F.expr(NO_HITS)


def _hit_sql(leaf_seq, ptr, rule_seq, match_seq, rule_id, category, st, en, action, priority, template) -> str:
    """One hit; ``action`` is a pair of SQL texts (action, rank)."""
    return (
        f"named_struct('leaf_seq', {leaf_seq}, 'ptr', {ptr}, 'rule_seq', {rule_seq}, 'match_seq', {match_seq}, "
        f"'rule_id', {rule_id}, 'category', {lit(category)}, 'st', {st}, 'en', {en}, 'action', {action[0]}, "
        f"'rank', {action[1]}, 'priority', {priority}, 'template', cast({lit(template)} as string))"
    )


def fixed_action(action: str) -> tuple[str, str]:
    return lit(action), str(RANK[action])


def _candidates_sql(rule: Rule, text: str, allow: str | None) -> str:
    """Spans of one rule that survive allowlists, validator and context, with their priority."""
    spans = M.spans_sql(text, rule.pattern)
    keep = []
    if allow is not None:
        keep.append(f"not array_contains({allow}, {M.exact_key_sql('c.v')})")
    candidate = M.normalized_sql("c.v", rule.normalization)
    if rule.validator == "luhn":
        keep.append(M.luhn_sql(candidate))
    allowed = _allow_values(rule)
    if allowed:
        keep.append(f"{candidate} not in ({', '.join(map(lit, allowed))})")
    if keep:
        spans = f"filter({spans}, c -> {' and '.join(keep)})"
    ctx = rule.context
    if ctx is None:
        return f"transform({spans}, c -> named_struct('st', c.st, 'en', c.en, 'prio', {rule.priority}))"
    near = f"lower({M.window_sql(text, 'c.st', 'c.en', ctx.window)})"
    spans = f"transform({spans}, c -> named_struct('st', c.st, 'en', c.en, 'near', {near}))"
    positive, negative = (M.any_of_sql("c.near", [t.lower() for t in terms]) for terms in (ctx.positive, ctx.negative))
    spans = f"transform({spans}, c -> named_struct('st', c.st, 'en', c.en, 'pos', {positive}, 'neg', {negative}))"
    vetoes = ["c.pos"] * ctx.require_positive + ["not c.neg"] * ctx.suppress_on_negative
    if vetoes:
        spans = f"filter({spans}, c -> {' and '.join(vetoes)})"
    base = min(rule.priority, MAX_CONTEXT_SCORE)
    score = f"greatest(0, {base} + if(c.pos, {ctx.boost}, 0) - if(c.neg, {ctx.penalty}, 0))"
    return f"transform({spans}, c -> named_struct('st', c.st, 'en', c.en, 'prio', {score}))"


def _allow_values(rule: Rule) -> list[str]:
    """The rule's own allowlist in the form candidates are compared in.

    Denylist rules fold their allowlist (case and whitespace) but compare the raw leaf, so there an
    entry with capitals never matches; callers rely on that.
    """
    if rule.denylist:
        values = {" ".join(v.split()).lower() for v in rule.allowlist}
    elif rule.normalization == "lowercase":
        values = {v.lower() for v in rule.allowlist}
    elif rule.normalization == "alnum_lowercase":
        values = {"".join(c for c in v if c.isascii() and c.isalnum()).lower() for v in rule.allowlist}
    else:
        values = set(rule.allowlist)
    return sorted(v for v in values if v)


def rule_hits_sql(
    rule: Rule, rule_seq: int, leaf_seq: str, ptr: str, text: str, low: str, action: tuple[str, str],
    allow: str | None = None, static_ptr: str | None = None,
) -> str | None:
    """The hits of one rule on one leaf; ``None`` when a known pointer rules it out."""
    conds = []
    if rule.gate:
        if static_ptr is not None:
            if not static_ptr.endswith(rule.gate):
                return None
        else:
            conds.append("(" + " or ".join(f"endswith({ptr}, {lit(s)})" for s in rule.gate) + ")")
    if rule.guard:
        conds.append(M.GUARDS[rule.guard](text, low))
    if rule.context is not None and rule.context.require_positive:
        conds.append(M.any_of_sql(low, [t.lower() for t in rule.context.positive]))

    if rule.denylist:
        found = _denylist_sql(rule, rule_seq, leaf_seq, ptr, text, action, allow)
    else:
        hit = _hit_sql(leaf_seq, ptr, rule_seq, "i", lit(rule.rule_id), rule.category, "s.st", "s.en", action,
                       "s.prio", rule.template)
        found = f"transform({_candidates_sql(rule, text, allow)}, (s, i) -> {hit})"
    return f"if({' and '.join(conds)}, {found}, {NO_HITS})" if conds else found


def _denylist_sql(rule, rule_seq, leaf_seq, ptr, text, action, allow) -> str:
    places: dict[str, list[int]] = {}
    for i, value in enumerate(rule.denylist):
        places.setdefault(value, []).append(i)
    pairs = ", ".join(f"{lit(v)}, array({', '.join(map(str, idx))})" for v, idx in places.items())
    where = f"coalesce(try_element_at(map({pairs}), {text}), cast(array() as array<int>))"
    hit = _hit_sql(leaf_seq, ptr, f"{rule_seq} + i", "0", f"concat({lit(rule.rule_id)}, i)", rule.category, "0",
                   f"char_length({text})", action, rule.priority, rule.template)
    keep = []
    if allow is not None:
        keep.append(f"not array_contains({allow}, {M.exact_key_sql(text)})")
    allowed = _allow_values(rule)
    if allowed:
        keep.append(f"{text} not in ({', '.join(map(lit, allowed))})")
    found = f"transform({where}, i -> {hit})"
    return f"if({' and '.join(keep)}, {found}, {NO_HITS})" if keep else found


def leaf_hits_sql(
    policy: Policy, leaf_seq: str, ptr: str, text: str, low: str, *, profile_id: str | None = None,
    profile_col: str | None = None, actions: dict[str, tuple[str, str]] | None = None, allow: str | None = None,
    static_ptr: str | None = None,
) -> str:
    """All hits on one leaf in rule order, as SQL text over the named columns.

    With ``profile_id`` the profile is fixed and actions are literals. Otherwise ``profile_col``
    holds the profile of the row and ``actions`` its (action, rank) per category.
    """
    parts = []
    for seq, rule in enumerate(BUILTIN_RULES):
        if rule.action:
            action = fixed_action(rule.action)
        elif profile_id is not None:
            action = fixed_action(policy.by_id[profile_id].action_for(rule.category))
        else:
            action = actions[rule.category]
        parts.append(rule_hits_sql(rule, seq, leaf_seq, ptr, text, low, action, allow, static_ptr))
    for profile in policy.profiles:
        if profile_id is not None and profile.profile_id != profile_id:
            continue
        own = len(BUILTIN_RULES)
        for rule in profile.configured_rules():
            action = fixed_action(rule.action or profile.action_for(rule.category))
            hits = rule_hits_sql(rule, own, leaf_seq, ptr, text, low, action, allow, static_ptr)
            if hits is not None and profile_col is not None:
                hits = f"if({profile_col} = {lit(profile.profile_id)}, {hits}, {NO_HITS})"
            parts.append(hits)
            own += len(rule.denylist) or 1
    parts = [p for p in parts if p is not None]
    return f"concat({', '.join(parts)})" if parts else NO_HITS


def rank_of(action: Column) -> Column:
    return F.element_at(F.expr(RANK_MAP), action)


def evidence_class(rule_id: Column) -> Column:
    return (
        F.when(F.startswith(rule_id, F.lit("deterministic.")), "deterministic_rule")
        .when(F.startswith(rule_id, F.lit("custom.")), "custom_rule")
        .otherwise("built_in_rule")
    )


def recognizer_family(rule_id: Column) -> Column:
    """The family a hit is counted in: ids without a known prefix count as built in."""
    out = F.lit("builtin")
    for family in ("custom", "deterministic", "ner"):
        out = F.when(F.startswith(rule_id, F.lit(family + ".")), family).otherwise(out)
    return out


def byte_offsets(text: Column, st: Column, en: Column) -> tuple[Column, Column]:
    """UTF-8 offsets of a character span."""
    start = F.octet_length(F.substring(text, F.lit(1), st))
    return start, start + F.octet_length(F.substring(text, st + 1, en - st))
