"""What happens to a matched fragment: mask, pseudonym, replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.arrays import let

# FNV-1a 64-bit parameters and the replacement texts.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
REDACTED = "[REDACTED]"
REPLACED = "[REPLACED]"
BLOCKED = "[BLOCKED]"
ID_HASH = "[ID_HASH]"


def mask_keep_suffix(fragment: Column, visible: int | Column) -> Column:
    """Star every non-blank character but the last ``visible`` ones; short fragments stay readable."""
    visible = F.lit(visible) if isinstance(visible, int) else visible
    n = F.char_length(fragment)
    keep = F.least(visible, n)
    head = F.substring(fragment, F.lit(1), n - keep)
    return F.concat(F.regexp_replace(head, r"(?U)\S", "*"), F.substring(fragment, n - keep + 1, keep))


def fnv1a_hex(value: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, 16 hex digits.

    The 64-bit product would overflow a long under ANSI rules, so the hash is kept as two 32-bit
    halves. The prime is 2^40 + 435: with hash = hi * 2^32 + lo the product modulo 2^64 is
    lo * 435 + ((hi * 435 + lo * 256) * 2^32), every part of which fits a long.
    """
    lo32 = F.lit(0xFFFFFFFF).cast("bigint")
    low_prime = F.lit(FNV_PRIME - (1 << 40)).cast("bigint")
    hex_bytes = F.hex(F.encode(value, "UTF-8"))
    size = F.octet_length(value)
    start = F.struct(
        F.lit(FNV_OFFSET >> 32).cast("bigint").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("bigint").alias("lo"))

    def step(acc, i):
        byte = F.conv(F.substring(hex_bytes, F.lit(2) * i - 1, F.lit(2)), 16, 10).cast("bigint")
        lo = acc["lo"].bitwiseXOR(byte)
        low_product = lo * low_prime
        high = acc["hi"] * low_prime + F.shiftleft(lo, 8) + F.shiftright(low_product, 32)
        return F.struct(high.bitwiseAND(lo32).alias("hi"), low_product.bitwiseAND(lo32).alias("lo"))

    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda acc: F.concat(
        F.lpad(F.lower(F.hex(acc["hi"])), 8, "0"), F.lpad(F.lower(F.hex(acc["lo"])), 8, "0")))


def stable_pseudonym(value: Column) -> Column:
    return F.concat(F.lit("[ID_HASH:"), fnv1a_hex(value), F.lit("]"))


def transformed(fragment: Column, action: Column, template: Column, visible: int | Column) -> Column:
    return (
        F.when(action == "redact", F.lit(REDACTED))
        .when(action == "mask", let(fragment, lambda f: mask_keep_suffix(f, visible)))
        .when((action == "replace") & (template == ID_HASH), let(fragment, stable_pseudonym))
        .when(action == "replace", F.coalesce(template, F.lit(REPLACED)))
        .when(action == "block", F.lit(BLOCKED))
        .otherwise(fragment)
    )


CHUNK_BITS = 8  # a text is cut into chunks of 256 characters before parts are taken out of it


def chunks_of(text: Column) -> Column:
    """The text in chunks of equal length, but for the last."""
    size = 1 << CHUNK_BITS
    return F.when(F.char_length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def between(chunks: Column, st: Column, en: Column) -> Column:
    """Characters ``st`` to ``en`` of a chunked text. Only the chunks they lie in are read, while ``substring``
    counts through the whole text before them."""
    first = F.shiftright(st, CHUNK_BITS)
    count = F.greatest(F.shiftright(en - 1, CHUNK_BITS) - first + 1, F.lit(0))
    return F.substring(F.array_join(F.slice(chunks, first + 1, count), ""), st - F.shiftleft(first, CHUNK_BITS) + 1, en - st)


def apply_spans(text: Column, spans: Column, visible: int | Column) -> Column:
    """Rewrite the spans of one leaf; they are disjoint and sorted by start.

    Each span contributes the untouched text before it and its own fragment, so the pieces only
    need joining and nothing is copied span by span.
    """
    def rewritten(chunks: Column, n: Column) -> Column:
        def piece(s, i):
            prev = F.when(i > 0, F.element_at(spans, F.greatest(i, F.lit(1)))["en"]).otherwise(F.lit(0))
            return F.concat(
                between(chunks, prev, s["st"]),
                transformed(between(chunks, s["st"], F.least(s["en"], n)), s["action"], s["template"], visible),
            )

        last = F.element_at(spans, -1)["en"]
        return F.concat(F.array_join(F.transform(spans, piece), ""), between(chunks, last, n))

    return F.when(F.size(spans) > 0, let(chunks_of(text), lambda c: let(
        F.char_length(text), lambda n: rewritten(c, n)))).otherwise(text)
