"""Rules and profiles as data.

A rule is a row of configuration: what to look for, in which field, with what priority and action.
Patterns are written in the portable syntax shared by RE2-style engines; ``functions.regex`` turns
them into the JVM dialect.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from veilframe.functions.regex import check_pattern

# The order of strictness, the categories and the limits of the score types.
ACTIONS = ("allow", "mask", "replace", "redact", "block")
RANK = {action: rank for rank, action in enumerate(ACTIONS)}
CATEGORIES = ("secrets", "pii", "corporate_markers", "custom")
MAX_PRIORITY = 65535
MAX_CONTEXT_SCORE = 32767
MAX_MASK_SUFFIX = 8
DENYLIST_BOOST = 1000


@dataclass(frozen=True)
class Context:
    """Words near a match that raise, lower or veto it."""

    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    boost: int = 10
    penalty: int = 10
    window: int = 32
    suppress_on_negative: bool = False
    require_positive: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    pattern: str
    priority: int = 100
    action: str | None = None  # None: the profile's action for the category
    template: str | None = None
    validator: str = "none"  # none | luhn
    normalization: str = "preserve"  # preserve | lowercase | alnum_lowercase
    context: Context | None = None
    gate: tuple[str, ...] = ()  # JSON pointer suffixes
    allowlist: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()  # whole-leaf values; replaces the pattern
    guard: str | None = None  # see functions.match.GUARDS


@dataclass(frozen=True)
class Recognizer:
    """A configured recognizer: several patterns and lists that share an action."""

    recognizer_id: str
    category: str
    action: str
    family_priority: int
    patterns: tuple[dict, ...] = ()
    context: Context | None = None
    allowlist: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Profile:
    profile_id: str
    actions: dict[str, str]
    mask_visible_suffix: int = 4
    max_hits: int | None = None  # explicit limit; rows above it are blocked, never released in part
    mode_default: str = "enforce"
    rules: tuple[Rule, ...] = ()
    recognizers: tuple[Recognizer, ...] = ()
    ner_enabled: bool = False

    def action_for(self, category: str) -> str:
        if category == "custom" and "custom" not in self.actions:
            return self.actions["corporate_markers"]
        return self.actions[category]

    def configured_rules(self) -> tuple[Rule, ...]:
        return self.rules + tuple(r for rec in self.recognizers for r in expand_recognizer(rec))


@dataclass(frozen=True)
class Policy:
    """The profiles known to a job and the one used when a request names none."""

    profiles: tuple[Profile, ...]
    default_profile: str = "strict"
    by_id: dict[str, Profile] = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "by_id", {p.profile_id: p for p in self.profiles})
        check_policy(self)


# Pointer suffixes of the field-gated rules.
PHONE_FIELDS = ("/phone", "/phone_number", "/phoneNumber", "/mobile", "/mobile_phone", "/mobilePhone")
PERSON_NAME_FIELDS = (
    "/first_name", "/last_name", "/middle_name", "/firstname", "/lastname", "/middlename",
    "/firstName", "/lastName", "/middleName", "/full_name", "/fullName", "/author", "/committer",
    "/contact_name", "/contactName", "/user.name", "/user/name",
)

# Words that must stand near a domain or a phone number.
DOMAIN_CONTEXT = Context(
    positive=(
        "url", "domain", "host", "hostname", "endpoint", "api", "repo", "website", "site", "portal",
        "server", "link", "visit", "connect", "домен", "хост", "сайт",
    ),
    window=40,
    require_positive=True,
)
PHONE_CONTEXT = Context(
    positive=(
        "phone", "mobile", "call", "contact", "telephone", "tel", "whatsapp", "telegram",
        "телефон", "мобильн", "звон", "контакт",
    ),
    window=40,
    require_positive=True,
)

# The built-in detection patterns, in detection order.
PHONE = r"(?:(?:\+7|8)[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}(?:[ -]?\d{2}){2}|(?:\+?\d{1,3}[ -]?)?(?:\(?\d{3}\)?[ -]?)\d{3}[ -]?\d{4})"
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule("builtin.secrets.bearer_token", "secrets",
         r"(?i)\bbearer\s+(?:gh[pousr]_[a-z0-9]{20,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|[A-Za-z0-9._\-]{24,})\b",
         470, guard="bearer"),
    Rule("builtin.secrets.basic_token", "secrets",
         r"(?i)\bauthorization\s*:\s*basic\s+[A-Za-z0-9+/=]{8,}",
         469, guard="authorization"),
    Rule("builtin.secrets.secret_assignment", "secrets",
         r"""(?i)\b(?:token|secret|api[_-]?key|access[_-]?token|auth[_-]?token)\s*[:=]\s*['"]?(?:gh[pousr]_[a-z0-9]{20,}|sk[-_][a-z0-9][a-z0-9_-]{8,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+|[A-Za-z0-9._\-]{24,})['"]?""",
         468, guard="assignment"),
    Rule("builtin.secrets.sk_api_key", "secrets",
         r"(?i)\bsk[-_][a-z0-9][a-z0-9_-]{8,}\b",
         465, guard="sk_key"),
    Rule("builtin.secrets.github_pat", "secrets",
         r"(?i)\bgh[pousr]_[a-z0-9]{20,}\b",
         466, guard="pat"),
    Rule("builtin.pii.email", "pii",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
         320, guard="at"),
    Rule("builtin.pii.url", "pii",
         r"(?i)\b(?:https?|ftp)://[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+(?::\d{2,5})?(?:/[a-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*[a-z0-9/#])?",
         319, guard="scheme"),
    Rule("builtin.pii.domain", "pii",
         r"(?i)\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b",
         318, context=DOMAIN_CONTEXT, guard="dot"),
    Rule("builtin.pii.ipv4", "pii",
         r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
         318, guard="dotted_digits"),
    Rule("builtin.pii.phone", "pii", PHONE, 317, context=PHONE_CONTEXT, guard="phone_digits"),
    Rule("builtin.pii.phone_field", "pii", PHONE, 317, gate=PHONE_FIELDS),
    Rule("builtin.pii.name_field", "pii",
         r"^(?:[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё'-]{0,63})(?:\s+[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё'-]{0,63}){0,2}$",
         316, gate=PERSON_NAME_FIELDS),
    Rule("builtin.pii.person_identity_field", "pii",
         r"^(?:[a-z][a-z0-9]*(?:[._-][a-z0-9]+){1,}|[А-ЯЁ][а-яё]{1,30}\s+[А-ЯЁ][а-яё]{1,30}\s+[А-ЯЁ][а-яё]{1,30}(?:\s*\(\d{4,12}\))?)$",
         315, gate=("/name", "/username")),
    Rule("builtin.pii.person_id_field", "pii",
         r"^(?:[0-9]{6,20}|[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12})$",
         314, action="replace", template="[ID_HASH]", gate=("/id",)),
    Rule("builtin.pii.customer_id_field", "pii",
         r"^[A-Za-z][A-Za-z0-9._-]{4,31}$",
         313, gate=("/customer_id", "/customerId", "/client_id", "/clientId")),
    Rule("builtin.pii.account_number_field", "pii",
         r"^[A-Z]?\d{8,20}$",
         312, gate=("/account_number", "/accountNumber")),
    Rule("builtin.pii.swift_bic_field", "pii",
         r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$",
         311, gate=("/swift_bic", "/swiftBic")),
    Rule("builtin.pii.medical_record_number", "pii",
         r"\b(?:MRN-\d{5,8}|MED\d{8}|[A-Z]\d{7})\b",
         309, guard="record_digits"),
    Rule("builtin.pii.license_plate", "pii",
         r"\b(?:[A-Z]{2,3}\s\d{3}|[A-Z]{2}\d{8,10})\b",
         308, guard="plate_digits"),
    Rule("builtin.pii.en_address_like_high_risk", "pii",
         r"\b(?:[NSEW]\s+[A-Z][a-z]{2,20}(?:\s+[A-Z][a-z]{2,20}){0,4}|\d{1,5}\s+Avenida(?:\s+[A-Za-z]{2,20}){1,5}|\d{1,5}\s+(?:[A-Za-z]{2,20}\s+){1,6}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Trail|Terrace|Brook|Common|Crossway|Marg))\b",
         307, guard="address_words"),
    Rule("builtin.pii.identity_context_name", "pii",
         r"\b(?i:my name is|i am|signed by|author:|from:|contact:)\s+[A-ZА-ЯЁ][a-zа-яё'-]{1,30}(?:\s+[A-ZА-ЯЁ][a-zа-яё'-]{1,30}){1,2}\b",
         306, guard="introduction"),
    Rule("builtin.pii.card_number", "pii",
         r"\b\d(?:[ -]?\d){12,15}\b",
         310, guard="card_digits"),
    Rule("builtin.corporate.project_name", "corporate_markers",
         r"(?i)\bproject\s+[a-z][a-z0-9_-]{2,}\b",
         220, guard="project"),
)

# What each shipped profile does per category.
MINIMAL = Profile("minimal", {"secrets": "mask", "pii": "allow", "corporate_markers": "allow"})
STRICT = Profile("strict", {"secrets": "block", "pii": "redact", "corporate_markers": "mask"}, ner_enabled=True)
CUSTOM = Profile("custom", {"secrets": "redact", "pii": "mask", "corporate_markers": "mask"}, mode_default="dry_run")


def expand_recognizer(rec: Recognizer) -> list[Rule]:
    """One rule per pattern and one per denylist value; ids spell out how the rule checks a match."""
    if not rec.enabled:
        return []
    rules = []
    for pattern in rec.patterns:
        validator = pattern.get("validator", "none")
        normalization = pattern.get("normalization", "preserve")
        rules.append(Rule(
            f"deterministic.{rec.recognizer_id}.pattern.{pattern['id']}.validator.{validator}.norm.{normalization}",
            rec.category, pattern["expression"],
            min(MAX_PRIORITY, rec.family_priority + pattern.get("base_score", 100)),
            action=rec.action, validator=validator, normalization=normalization,
            # configured contexts can veto on a negative word but never require a positive one
            context=replace(rec.context, require_positive=False) if rec.context else None,
            allowlist=rec.allowlist,
        ))
    if rec.denylist:
        rules.append(Rule(
            f"deterministic.{rec.recognizer_id}.denylist.", rec.category, "",
            min(MAX_PRIORITY, rec.family_priority + DENYLIST_BOOST),
            action=rec.action, allowlist=rec.allowlist, denylist=rec.denylist,
        ))
    return rules


def check_policy(policy: Policy) -> None:
    """Reject configuration the detection expressions cannot honour."""
    if policy.default_profile not in policy.by_id:
        raise ValueError(f"default profile '{policy.default_profile}' is missing")
    for profile in policy.profiles:
        if not 0 <= profile.mask_visible_suffix <= MAX_MASK_SUFFIX:
            raise ValueError(f"profile '{profile.profile_id}': mask_visible_suffix must be at most {MAX_MASK_SUFFIX}")
        for rule in profile.configured_rules():
            if not rule.denylist:
                check_pattern(rule.rule_id, rule.pattern)


DEFAULT_POLICY = Policy((MINIMAL, STRICT, CUSTOM))

RULE_SCHEMA = (
    "profile_id string, rule_seq int, rule_id string, category string, pattern string, priority int, "
    "action string, template string, validator string, normalization string, "
    "context struct<positive:array<string>,negative:array<string>,boost:int,penalty:int,window:int,"
    "suppress_on_negative:boolean,require_positive:boolean>, gate array<string>, allowlist array<string>"
)


def rules_table(spark: SparkSession, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Every rule of every profile with its effective action, for joins and reports."""
    rows = []
    for profile in policy.profiles:
        seq = 0
        for rule in BUILTIN_RULES + profile.configured_rules():
            for suffix, pattern in _rule_values(rule):
                ctx = rule.context
                rows.append((
                    profile.profile_id, seq, rule.rule_id + suffix, rule.category, pattern, rule.priority,
                    rule.action or profile.action_for(rule.category), rule.template, rule.validator,
                    rule.normalization,
                    (list(ctx.positive), list(ctx.negative), ctx.boost, ctx.penalty, ctx.window,
                     ctx.suppress_on_negative, ctx.require_positive) if ctx else None,
                    list(rule.gate), list(rule.allowlist),
                ))
                seq += 1
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _rule_values(rule: Rule) -> Iterable[tuple[str, str]]:
    if rule.denylist:
        return [(str(i), value) for i, value in enumerate(rule.denylist)]
    return [("", rule.pattern)]


def profile_actions(spark: SparkSession, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    rows = [(p.profile_id, c, p.action_for(c)) for p in policy.profiles for c in CATEGORIES]
    return spark.createDataFrame(rows, "profile_id string, category string, action string")
