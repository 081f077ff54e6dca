"""Match offsets and candidate checks.

Offsets count characters. One pass of the regex marks every match inside the text; splitting at the
mark then yields gap, match, gap, match, ... and a running length gives each match its place.

The builders return SQL text: a rule set is a large expression, and one parsed string is far cheaper
to set up than thousands of column calls. ``Column`` wrappers exist where a query needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.regex import jvm

MARK = "￿"  # a noncharacter; texts that hold it anyway take the two-pass branch
BLOCK_BITS = (2, 4, 4)  # sums are taken over blocks of 4 matches, then of 16 blocks, then of 16 of those
SPAN_TYPE = "array<struct<st:int,en:int,v:string>>"


def lit(value) -> str:
    """A SQL literal."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(text: str, pattern: str) -> str:
    """All non-overlapping matches of ``pattern``, left to right, as ``array<struct<st,en,v>>``."""
    p = lit(jvm(pattern))
    marked = f"split(regexp_replace({text}, {p}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    found = f"regexp_extract_all({text}, {p}, 0)"
    two_pass = (f"slice(flatten(zip_with(split({text}, {p}, -1), {found}, (g, m) -> array(g, m))), "
                f"1, 2 * size({found}) + 1)")
    parts = f"if(contains({text}, '{MARK}'), {two_pass}, {marked})"
    # a fold copies what it has gathered at every step, so only numbers are folded
    found = (f"transform(ss, (s, k) -> named_struct('st', s + char_length(ps[2 * k]), "
             f"'en', s + char_length(ps[2 * k]) + char_length(ps[2 * k + 1]), 'v', ps[2 * k + 1]))")
    pairs = ("transform(sequence(0, shiftright(size(ps), 1) - 1), "
             "k -> char_length(ps[2 * k]) + char_length(ps[2 * k + 1]))")
    placed = let_sql(let_sql(pairs, "ls", _sums_before_sql("ls")), "ss", found)
    return let_sql(parts, "ps", f"if(size(ps) < 2, cast(array() as {SPAN_TYPE}), {placed})")


def let_sql(value: str, name: str, body: str) -> str:
    """``body`` of a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums_before_sql(items: str, bits: tuple[int, ...] = BLOCK_BITS) -> str:
    """For each number the sum of all before it: the rest of its block on top of the sum of all blocks before.

    ``bits`` has the block size of each level as a power of two; few blocks are left above the last.
    """
    add = "(a, n) -> a + n"
    if not bits:
        return f"transform({items}, (m, j) -> aggregate(slice({items}, 1, j), 0, {add}))"
    size, blocks, sums = 1 << bits[0], f"{items}b", f"{items}s"
    totals = (f"transform(sequence(0, shiftright(size({items}) - 1, {bits[0]})), "
              f"j -> aggregate(slice({items}, {size} * j + 1, {size}), 0, {add}))")
    head = f"{sums}[shiftright(j, {bits[0]})]"
    if size <= 4:  # spelt out: a slice and a fold cost more than the few numbers they add
        cases = [" + ".join([head, *(f"{items}[j - {back}]" for back in range(1, n + 1))]) for n in range(size)]
        here = "case j & {} {} end".format(size - 1, " ".join(f"when {n} then {c}" for n, c in enumerate(cases)))
    else:
        here = f"aggregate(slice({items}, j - (j & {size - 1}) + 1, j & {size - 1}), {head}, {add})"
    inside = f"transform({items}, (m, j) -> {here})"
    return let_sql(let_sql(totals, blocks, _sums_before_sql(blocks, bits[1:])), sums, inside)


def match_spans(text: str, pattern: str) -> Column:
    return F.expr(spans_sql(text, pattern))


def any_of_sql(text: str, terms) -> str:
    return "(" + (" or ".join(f"contains({text}, {lit(t)})" for t in terms) or "false") + ")"


def seen_sql(text: str, pattern: str) -> str:
    return f"rlike({text}, {lit(jvm(pattern))})"


# A guard is a cheap condition every text with a match satisfies, so the regex only runs where it
# can succeed. Letters that case-fold from outside ASCII (long s, Kelvin sign) stay out of them.
GUARDS = {
    "bearer": lambda t, low: any_of_sql(low, ["bearer"]),
    "authorization": lambda t, low: any_of_sql(low, ["authorization"]),
    "assignment": lambda t, low: any_of_sql(low, ["token", "ecret", "key"]) + " and " + any_of_sql(t, [":", "="]),
    "sk_key": lambda t, low: any_of_sql(low, ["k-", "k_"]),
    "pat": lambda t, low: any_of_sql(low, ["gh"]) + " and " + any_of_sql(t, ["_"]),
    "at": lambda t, low: any_of_sql(t, ["@"]),
    "scheme": lambda t, low: any_of_sql(t, ["://"]),
    "dot": lambda t, low: any_of_sql(t, ["."]),
    "introduction": lambda t, low: any_of_sql(low, ["my name i", "i am", "igned by", "author:", "from:", "contact:"]),
    "project": lambda t, low: any_of_sql(low, ["project"]),
    "dotted_digits": lambda t, low: any_of_sql(t, ["."]) + " and " + seen_sql(t, r"\d\.\d{1,3}\.\d"),
    "phone_digits": lambda t, low: seen_sql(t, r"\d{3}[ -]?\d{2}"),
    "record_digits": lambda t, low: seen_sql(t, r"[A-Z-]\d{5}"),
    "plate_digits": lambda t, low: seen_sql(t, r"[A-Z]\s?\d{3}"),
    "address_words": lambda t, low: seen_sql(t, r"[NSEW]\s+[A-Z][a-z]{2}|\d\s+[A-Za-z]{2}"),
    "card_digits": lambda t, low: seen_sql(t, r"\d(?:[ -]?\d){12}"),
}


def normalized_sql(value: str, mode: str) -> str:
    """How a candidate is compared: as is, lower-cased, or ASCII letters and digits lower-cased."""
    if mode == "lowercase":
        return f"lower({value})"
    if mode == "alnum_lowercase":
        return f"lower(regexp_replace({value}, '[^A-Za-z0-9]', ''))"
    return value


def exact_key_sql(value: str) -> str:
    """Whitespace folded and lower-cased: how request allowlists compare values."""
    return f"lower(trim(regexp_replace({value}, {lit(r'(?U)\s+')}, ' ')))"


def luhn_sql(value: str) -> str:
    """At least 13 digits and a valid check digit."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    return f"(char_length({digits}) >= 13 and luhn_check({digits}))"


def window_sql(text: str, st: str, en: str, width: int) -> str:
    """The match with up to ``width`` characters on either side."""
    left = f"greatest({st} - {width}, 0)"
    return f"substring({text}, {left} + 1, {en} + {width} - {left})"
