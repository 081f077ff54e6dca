"""SQL-callable helpers, defined in SQL so they run without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilframe.functions.fragments import FNV_OFFSET, FNV_PRIME

_LOW = 0xFFFFFFFF
_STEP = FNV_PRIME - (1 << 40)

FUNCTIONS = {
    # the hash as two halves of 32 bits, see fragments.fnv1a_hex
    "fnv_id_hash": (
        "(value string) returns string return aggregate(transform(filter(sequence(0, octet_length(value)), j -> j > 0), "
        "i -> cast(conv(substring(hex(encode(value, 'UTF-8')), 2 * i - 1, 2), 16, 10) as bigint)), "
        f"named_struct('hi', {FNV_OFFSET >> 32}L, 'lo', {FNV_OFFSET & _LOW}L), "
        f"(acc, b) -> named_struct('hi', (acc.hi * {_STEP} + shiftleft(acc.lo ^ b, 8) + shiftright((acc.lo ^ b) * {_STEP}, 32)) & {_LOW}L, "
        f"'lo', ((acc.lo ^ b) * {_STEP}) & {_LOW}L), "
        "acc -> concat('[ID_HASH:', lpad(lower(hex(acc.hi)), 8, '0'), lpad(lower(hex(acc.lo)), 8, '0'), ']'))"),
    "mask_keep_suffix": (
        "(fragment string, visible int) returns string return concat("
        "regexp_replace(left(fragment, char_length(fragment) - least(visible, char_length(fragment))), '(?U)\\\\S', '*'), "
        "right(fragment, least(visible, char_length(fragment))))"),
    "logical_path": (
        "(ptr string) returns string return array_join(transform(filter(split(ptr, '/'), x -> x <> ''), "
        "x -> replace(replace(x, '~1', '/'), '~0', '~')), '.')"),
    "path_segments": (
        "(path string) returns array<string> return case when path rlike '^([/\\\\\\\\]|[A-Za-z]:)' then null else "
        "aggregate(filter(split(path, '[/\\\\\\\\]'), s -> s <> '' and s <> '.'), cast(array() as array<string>), "
        "(acc, s) -> case when acc is null then null when s <> '..' then concat(acc, array(s)) "
        "when size(acc) > 0 then slice(acc, 1, size(acc) - 1) end) end"),
    "gateway_fingerprint": "(token string) returns string return concat('gw_', substring(sha2(token, 256), 1, 32))",
}


def register(spark: SparkSession) -> None:
    for name, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
