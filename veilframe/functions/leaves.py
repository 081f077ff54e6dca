"""String leaves of structured payloads.

Typed columns are walked through their schema with built-in functions only. JSON text has no fixed
schema, so one Arrow-batched function lists its leaves and another writes new texts back.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship the Arrow functions with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_TYPE = "array<struct<leaf_seq:int,ptr:string,text:string>>"
NODE_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("ptr", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("key", T.StringType()), T.StructField("top", T.StringType())]))
NODE_ARROW = pa.list_(pa.struct([
    ("ptr", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("depth", pa.int32()), ("key", pa.string()),
    ("top", pa.string())]))


def escape_segment(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def single_leaf(text: Column, ptr: str) -> Column:
    return F.array(F.struct(F.lit(0).alias("leaf_seq"), F.lit(ptr).alias("ptr"), text.alias("text")))


def typed_leaves(value: Column, dtype: T.DataType) -> Column:
    """Leaves of a struct, array, map or string column, keys in byte order, nulls skipped."""
    raw = F.filter(_typed(value, dtype, F.lit("")), lambda x: x["text"].isNotNull())
    return F.transform(raw, lambda x, i: F.struct(i.alias("leaf_seq"), x["ptr"].alias("ptr"), x["text"].alias("text")))


def _none() -> Column:
    return F.array().cast("array<struct<ptr:string,text:string>>")


def _typed(value: Column, dtype: T.DataType, ptr: Column) -> Column:
    if isinstance(dtype, T.StringType):
        return F.array(F.struct(ptr.alias("ptr"), value.alias("text")))
    if isinstance(dtype, T.StructType):
        parts = []
        for f in sorted(dtype.fields, key=lambda f: f.name.encode()):
            if _has_strings(f.dataType):
                seg = "/" + f.name.replace("~", "~0").replace("/", "~1")
                parts.append(_typed(value[f.name], f.dataType, F.concat(ptr, F.lit(seg))))
        return F.coalesce(F.concat(*parts), _none()) if parts else _none()
    if isinstance(dtype, T.ArrayType) and _has_strings(dtype.elementType):
        inner = F.transform(value, lambda x, i: _typed(
            x, dtype.elementType, F.concat(ptr, F.lit("/"), i.cast("string"))))
        return F.coalesce(F.flatten(inner), _none())
    if isinstance(dtype, T.MapType) and _has_strings(dtype.valueType):
        entries = F.array_sort(F.map_keys(value))
        inner = F.transform(entries, lambda k: _typed(
            value[k], dtype.valueType, F.concat(ptr, F.lit("/"), escape_segment(k.cast("string")))))
        return F.coalesce(F.flatten(inner), _none())
    return _none()


def _has_strings(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_strings(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_strings(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_strings(dtype.valueType)
    return isinstance(dtype, T.StringType)


def rewrite_typed(value: Column, dtype: T.DataType, new_text: Column, ptr: Column | None = None) -> Column:
    """Rebuild a typed value with texts from the map ``new_text`` (pointer to text)."""
    ptr = F.lit("") if ptr is None else ptr
    if isinstance(dtype, T.StringType):
        return F.when(value.isNotNull(), F.coalesce(F.try_element_at(new_text, ptr), value))
    if isinstance(dtype, T.StructType) and _has_strings(dtype):
        fields = [
            rewrite_typed(value[f.name], f.dataType, new_text, F.concat(
                ptr, F.lit("/" + f.name.replace("~", "~0").replace("/", "~1")))).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and _has_strings(dtype):
        return F.transform(value, lambda x, i: rewrite_typed(
            x, dtype.elementType, new_text, F.concat(ptr, F.lit("/"), i.cast("string"))))
    if isinstance(dtype, T.MapType) and _has_strings(dtype.valueType):
        return F.transform_values(value, lambda k, v: rewrite_typed(
            v, dtype.valueType, new_text, F.concat(ptr, F.lit("/"), escape_segment(k.cast("string")))))
    return value


# ---- JSON text ---------------------------------------------------------------------------------


_TOKEN = re.compile(r'[ \t\n\r]*+("(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^ \t\n\r{}\[\]:,"]++)', re.S)


def segment(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _not_json(token):
    raise ValueError(token)


def is_json(raw: str | None) -> bool:
    """Strict JSON: no NaN or Infinity, no lone surrogates."""
    try:
        doc = json.loads(raw, parse_constant=_not_json)
        if "\\u" in raw:
            json.dumps(doc, ensure_ascii=False).encode()
        return True
    except (TypeError, ValueError, RecursionError):
        return False


class _Open:
    """A container that the scanner is in: its members so far, and the key that waits for a value."""

    def __init__(self, start: int, is_object: bool):
        self.start, self.is_object, self.members, self.key = start, is_object, [], None


def scan(raw: str) -> tuple[tuple, list[tuple[int, int]]]:
    """Tree of a JSON text, and the ranges of members that a later one of the same key hides.

    A node is its range in the text and its value: a dict or list of nodes, or a scalar. Such a hidden
    member reaches up to the next one, so the text without it is JSON again.
    """
    hidden: list[tuple[int, int]] = []
    stack: list[_Open] = []
    for token in _TOKEN.finditer(raw):
        mark, at = token[1], token.start(1)
        if mark in "{[":
            stack.append(_Open(at, mark == "{"))
            continue
        if mark in ":,":
            continue
        if mark in "}]":
            done = stack.pop()
            if done.is_object:
                last = {key: k for k, (key, _, _) in enumerate(done.members)}
                hidden += [(start, done.members[k + 1][1]) for k, (key, start, _) in enumerate(done.members) if last[key] != k]
                value = {key: node for key, _, node in done.members}
            else:
                value = [node for _, _, node in done.members]
            node = (done.start, token.end(), value)
        elif stack and stack[-1].is_object and stack[-1].key is None:
            stack[-1].key = (json.loads(mark), at)
            continue
        else:
            node = (at, token.end(), json.loads(mark))
        if not stack:
            return node, hidden
        key, start = stack[-1].key or (None, at)
        stack[-1].members.append((key, start, node))
        stack[-1].key = None
    raise ValueError("no document")


def walk(tree: tuple):
    """Scalars and empty containers of a document, keys sorted, with their nesting depth and range.

    ``top`` is the kind of the root's member that a node lies in.
    """
    stack = [("", tree, 1, None, None)]
    while stack:
        ptr, (start, end, node), depth, key, top = stack.pop()
        kind, text = _kind(node)
        top = kind if depth == 2 else top
        if isinstance(node, dict) and node:
            for k in sorted(node, key=lambda s: s.encode("utf-8", "surrogatepass"), reverse=True):
                stack.append((f"{ptr}/{segment(k)}", node[k], depth + 1, k, top))
        elif isinstance(node, list) and node:
            for i in range(len(node) - 1, -1, -1):
                stack.append((f"{ptr}/{i}", node[i], depth + 1, key, top))
        else:
            yield {"ptr": ptr, "kind": kind, "text": text, "depth": depth, "key": key, "top": top, "range": (start, end)}


def _kind(node) -> tuple[str, str | None]:
    if isinstance(node, str):
        return "string", node
    if node is None:
        return "null", None
    if isinstance(node, bool):
        return "boolean", "true" if node else "false"
    if isinstance(node, int):
        return "integer", str(node)
    if isinstance(node, float):
        return "number", repr(node)
    return ("object" if isinstance(node, dict) else "array"), None


def spliced(raw: str, texts: dict[str, str]) -> str:
    """The JSON text with the string leaves at some pointers replaced, and without members that a later one hides.

    Only these ranges change: numbers, white space and escapes elsewhere stay as they were written.
    """
    tree, hidden = scan(raw)
    edits = [(start, end, "") for start, end in hidden]
    if texts:
        edits += [(*n["range"], json.dumps(texts[n["ptr"]], ensure_ascii=False)) for n in walk(tree)
                  if n["kind"] == "string" and n["ptr"] in texts]
    out, at = [], 0
    for start, end, text in sorted(edits):
        if start >= at:  # else it lies in a member that is gone already
            out += [raw[at:start], text]
            at = end
    return "".join([*out, raw[at:]])


SLICE = 256  # rows that are Python objects at a time; a batch of the engine may hold many thousands


def by_slices(kind: pa.DataType, rows: Callable[..., list], *columns: pa.Array) -> pa.Array:
    """``rows`` of the columns' values, some rows at a time, so that memory does not grow with the batch."""
    parts = [pa.array(rows(*(c.slice(at, SLICE).to_pylist() for c in columns)), type=kind)
             for at in range(0, len(columns[0]), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


@F.arrow_udf(NODE_SCHEMA)
def json_nodes(payload: pa.Array) -> pa.Array:
    """Scalar leaves and empty containers in walk order; null when the text is not JSON.

    Of members with the same key the last one counts, as for any parser.
    """
    return by_slices(NODE_ARROW, lambda raws: [
        [{k: n[k] for k in ("ptr", "kind", "text", "depth", "key", "top")} for n in walk(scan(raw)[0])]
        if is_json(raw) else None for raw in raws], payload)


@F.arrow_udf(T.StringType())
def set_json_leaves(payload: pa.Array, texts: pa.Array) -> pa.Array:
    """The document with the string leaves named in ``texts`` (pointer to text) replaced, see ``spliced``.

    What was never scanned is not passed on: text that is not JSON gives null, and hidden members go.
    """
    return by_slices(pa.string(), lambda raws, changes: [
        spliced(raw, dict(pairs or ())) if is_json(raw) else None for raw, pairs in zip(raws, changes)], payload, texts)


# Catalyst treats Python functions as free to repeat and would copy them into every later expression.
# Marked as non-deterministic they run once and their result is a column like any other.
json_nodes = json_nodes.asNondeterministic()
set_json_leaves = set_json_leaves.asNondeterministic()


@dataclass(frozen=True)
class Processor:
    """How text payloads are read and written: ``nodes`` lists what is in one (null: cannot be read), ``rewrite``
    puts new texts (pointer to text) in. Both take and give columns; ``nodes`` gives ``NODE_SCHEMA``."""

    nodes: Callable[[Column], Column]
    rewrite: Callable[[Column, Column], Column]


JSON = Processor(json_nodes, set_json_leaves)


def string_leaves(nodes: Column) -> Column:
    strings = F.filter(nodes, lambda n: n["kind"] == "string")
    return F.transform(strings, lambda n, i: F.struct(
        i.alias("leaf_seq"), n["ptr"].alias("ptr"), n["text"].alias("text")))


def json_depth(nodes: Column) -> Column:
    """Nesting depth, root level 1; an empty container counts only its own level."""
    return F.array_max(F.transform(nodes, lambda n: n["depth"]))
