"""Event-stream bodies as payloads: the string leaves of every JSON event, and the body with new texts in their place."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.leaves import NODE_ARROW, NODE_SCHEMA, Processor, by_slices, is_json, scan, spliced, walk

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What Unicode calls white space, the field of payload lines, the last event.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
FIELD, DONE = "data:", "[DONE]"


def event_lines(body: str) -> list[list[tuple[str, str | None]]]:
    """The lines of every event that is not blank; a payload line comes with its trimmed payload."""
    events = []
    for event in body.split("\n\n"):
        if not event.strip(WHITE):
            continue
        *ended, rest = event.split("\n")
        lines = [line.removesuffix("\r") for line in ended] + ([rest] if rest else [])
        events.append([(line, line[len(FIELD):].strip(WHITE) if line.startswith(FIELD) else None) for line in lines])
    return events


def rebuilt(body: str, texts: dict[str, str]) -> str:
    """The body with the string leaves at ``/event/line/pointer`` replaced.

    Lines that are no payload, or a payload that is not JSON, stay as they are. JSON payloads change only in
    these leaves. Blank events go, and every event ends with an empty line.
    """
    by_line: dict[str, dict[str, str]] = {}
    for ptr, text in texts.items():
        _, event, line, *rest = ptr.split("/", 3)
        by_line.setdefault(f"{event}/{line}", {})["/" + rest[0] if rest else ""] = text
    out = []
    for i, lines in enumerate(event_lines(body)):
        done = []
        for j, (line, payload) in enumerate(lines):
            if payload == DONE:
                line = f"{FIELD} {DONE}"
            elif payload is not None and is_json(payload):
                line = f"{FIELD} {spliced(payload, by_line.get(f'{i}/{j}', {}))}"
            done.append(line)
        out.append("\n".join(done) + "\n\n")
    return "".join(out)


@F.arrow_udf(NODE_SCHEMA)
def event_nodes(body: pa.Array) -> pa.Array:
    """Nodes of all JSON payloads of a body, in order; pointers start with the place of event and line.

    A body can always be read: what is not JSON passes through by the rules of event streams. A null
    body has no nodes.
    """
    def nodes(text: str | None) -> list[dict]:
        found = []
        for i, lines in enumerate(event_lines(text or "")):
            for j, (_, payload) in enumerate(lines):
                if payload is not None and payload != DONE and is_json(payload):
                    found += [{"ptr": f"/{i}/{j}{n['ptr']}"} | {k: n[k] for k in ("kind", "text", "depth", "key", "top")}
                              for n in walk(scan(payload)[0])]
        return found

    return by_slices(NODE_ARROW, lambda texts: [nodes(text) for text in texts], body)


@F.arrow_udf(T.StringType())
def set_event_leaves(body: pa.Array, texts: pa.Array) -> pa.Array:
    """Bodies with new texts (pointer to text), see ``rebuilt``; null stays null."""
    return by_slices(pa.string(), lambda bodies, changes: [
        None if text is None else rebuilt(text, dict(pairs or ())) for text, pairs in zip(bodies, changes)], body, texts)


EVENTS = Processor(event_nodes.asNondeterministic(), set_event_leaves.asNondeterministic())
