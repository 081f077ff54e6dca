"""WARC archives: a writer with revisit records and a salvage reader that steps over damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import scratch, staged

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member: what the text writer puts between records, so a file stays a chain of members.
NOTHING = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
READ = 1 << 16

RECORD = ("archive string, start long, end long, kind string, record_id string, uri string, refers_to string, "
          "payload_bytes long, payload_digest string, payload binary, note string")


# --- bytes ------------------------------------------------------------------------------------

def record_bytes(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: bytes,
                 refers_to: str | None = None) -> bytes:
    """One record. A revisit carries no payload, only its digest and length."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date),
            ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri or "")),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()),
            ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
            ("X-Payload-Length", str(len(payload))), ("Content-Type", "text/html; charset=utf-8")]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to)]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data, at: int) -> tuple[dict | None, int, str]:
    """The record at ``at``: its fields with the payload, where it ends, or why it fails its checks."""
    view = bytes(data[at:at + 12])
    if not VERSION.match(view):
        return None, at, "no version line"
    stop, width = -1, 4096
    while stop < 0:
        head = bytes(data[at:at + width])
        stop = head.find(b"\r\n\r\n")
        if stop < 0 and at + width >= len(data):
            return None, at, "header does not end"
        width *= 4
    fields = {}
    for line in head[:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "header line without colon"
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return None, at, "no content length"
    begin = at + stop + 4
    end = begin + int(length)
    if bytes(data[end:end + 4]) != b"\r\n\r\n":
        return None, at, "block does not end where its length says"
    block = bytes(data[begin:end])
    told = fields.get("warc-block-digest", "")
    if told.lower().startswith("sha1:") and told[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return None, at, "block digest differs"
    return fields | {"payload": block}, end + 4, ""


def member(data, at: int) -> tuple[bytes, int, bool]:
    """What the gzip member at ``at`` holds, where it ends, and whether it is whole; else what comes before the damage."""
    inflate, out, here = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof and here < len(data):
            out.append(inflate.decompress(data[here:here + READ]))
            here += READ
    except zlib.error:
        return b"".join(out) + _before(data[here:here + READ], data[at:here]), at, False
    if not inflate.eof:
        return b"".join(out), at, False
    return b"".join(out), min(here, len(data)) - len(inflate.unused_data), True


def _before(part, read) -> bytes:
    """What ``part``, which fails to inflate as a whole after ``read``, yields byte by byte."""
    inflate, out = zlib.decompressobj(31), []
    for at in range(0, len(read), READ):
        inflate.decompress(read[at:at + READ])
    try:
        for at in range(len(part)):
            out.append(inflate.decompress(part[at:at + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _stretches(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """``salvage`` for inflated bytes: records and gaps, no members within."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        found, end, note = parse(data, at)
        if found:
            if gap >= 0:
                yield gap, at, None, why
                gap = -1
            yield at, end, found, ""
            at = end
            continue
        if gap < 0:
            gap, why = at, note
        at = data.find(b"WARC/1.", at + 1)
        if at < 0:
            break
    if gap >= 0:
        yield gap, len(data), None, why


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str]]:
    """``start, end, fields, note`` of every record, and of every byte gap, for which fields are None.

    Plain files and chains of gzip members may mix. After a failed check the search goes on one
    byte later, for the next version line or member that passes its own checks; the bytes between
    are one gap whose note is the first failure. Every byte lies in a record, an empty member or a gap.

    A member that holds one record has that record's place. One of more records, or one damaged or cut off after
    some, is searched in the same way: its records and gaps have its offset plus their inner one. The archive's own
    bytes of a damaged member are then a gap as well, up to the next mark that holds.
    """
    data, at, gap, why = memoryview(data), 0, -1, ""
    raw = data.obj
    ahead = {MAGIC: -1, b"WARC/1.": -1}
    while at < len(data):
        found, end, note, within = None, at, "", []
        if raw[at:at + 3] == MAGIC:
            body, end, whole = member(data, at)
            if whole and not body:
                if gap >= 0:
                    yield gap, at, None, why
                    gap = -1
                at = end
                continue
            if not whole:
                note = "damaged member"
            within = list(_stretches(body))
            if whole and len(within) == 1 and within[0][2]:
                found, within = within[0][2], []
            elif not any(fields for _, _, fields, _ in within):
                note, within = note or within[0][3], []
        elif raw[at:at + 5] == b"WARC/":
            found, end, note = parse(data, at)
        else:
            note = "no record begins here"
        if found or within:
            if gap >= 0:
                yield gap, at, None, why
                gap = -1
            if found:
                yield at, end, found, ""
            for start, stop, fields, inner in within:
                yield at + start, at + stop, fields, inner
            if end > at:
                at = end
                continue
        if gap < 0:
            gap, why = at, note
        for mark, place in ahead.items():  # a mark found further on stays found: the search is linear
            if place <= at:
                place = raw.find(mark, at + 1)
                ahead[mark] = place if place >= 0 else len(data)
        at = min(ahead.values())
    if gap >= 0:
        yield gap, len(data), None, why


# --- tables -----------------------------------------------------------------------------------

def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the pages whose payload another page holds.

    Only digests and ids are grouped, so a payload that a third of all pages share costs a few bytes a page.
    """
    seen = pages.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least)
    firsts = seen.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter(
        "n > 1").drop("n")
    return seen.join(firsts, "payload_digest").filter("page_id < refers_to").select(
        "page_id", "payload_digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``page_id, url, html, refers_to`` as gzip-compressed WARC files under ``path``, one member a record.

    Spark's text writer puts the members into files, so any store that Spark writes to will do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch, out = whole.slice(at, 64), []
                for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    name = f"<urn:page:{page}>" if page is not None else "<urn:page:>"
                    whom = None if refers is None else f"<urn:page:{refers}>"
                    out.append(gzip.compress(record_bytes(
                        "response" if refers is None else "revisit", name, url, date, payload,
                        hashlib.sha1(payload).digest(), whom), 6, mtime=0))
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    (pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archives under ``path``, with columns ``RECORD``.

    A record's kind is that of its header; a quarantined stretch of bytes has kind ``gap`` and a note.
    The digest is bare lower-case hex. A file is read as a whole by one task, so keep files at or below
    a few hundred megabytes, as archive writers do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                            ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary()), ("note", pa.string())])
        for batch in batches:
            for row in range(len(batch)):
                name, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                rows, held = [], 0
                for start, end, fields, note in salvage(data):
                    if fields is None:
                        rows.append((name, start, end, "gap", None, None, None, None, None, None, note))
                        continue
                    payload, told = fields["payload"], fields.get("warc-payload-digest", "")
                    kind = fields.get("warc-type")
                    if kind == "revisit":
                        size = int(fields["x-payload-length"]) if fields.get("x-payload-length", "").isdigit() else None
                        digest = (base64.b32decode(told[5:].upper()).hex()
                                  if re.fullmatch(r"(?i)sha1:[A-Z2-7]{32}", told) else None)
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append((name, start, end, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                                 fields.get("warc-refers-to"), size, digest, payload, None))
                    held += len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write a record per row of ``pages``, read the archives back, and return ``RECORD`` of all of them.

    Null html is an empty payload. Of records with equal payloads of at least ``least`` bytes, that with
    the largest ``page_id`` is the response and the others revisit it. A row with a null id is always a
    response. Repeated ids: rows of the largest id are all responses. No rows give no records.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html")
    if rows.isEmpty():
        return spark.createDataFrame([], RECORD)
    payload = F.coalesce(F.col("html"), F.lit(""))
    small = staged(rows.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"),
                               F.sha1(payload.cast("binary")).alias("payload_digest")), "digests")
    later = revisits(small, least)
    path = scratch(spark, "archives")
    keyed = rows.withColumn("payload_digest", F.sha1(payload.cast("binary")))
    write_archives(keyed.join(later, ["page_id", "payload_digest"], "left"), path)
    return read_archives(spark, path)
