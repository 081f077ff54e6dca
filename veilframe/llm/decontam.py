"""Benchmark decontamination: q-gram lemma over diagonal bands, then banded alignment.

Texts and items are compared in normal form: bytes with A-Z as a-z and white space runs as one space. An item
is cut into segments; a segment of length m may differ by k edits, and any stretch within k edits of it
shares at least m + 1 - q * (k + 1) q-grams with it, all on diagonals no more than k apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

Q = 8
#: Edits allowed per character of a segment, and the length segments aim at.
RATE, SEGMENT = 0.1, 110
#: Items below this length match only texts that equal them.
SHORT = 24
#: Bytes of benchmark text in one index; a larger benchmark is searched in that many passes over the documents.
INDEX_BYTES = 1 << 20
CHUNK = 1 << 19
BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def segments(item: bytes) -> list[bytes]:
    """Near-equal pieces of an item that together cover it."""
    parts = max(1, round(len(item) / SEGMENT))
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [item[a:b] for a, b in zip(cuts, cuts[1:])]


def budget(length: int) -> int:
    """Edits allowed in a segment: its share, as far as the lemma still asks for a few shared q-grams."""
    return max(0, min(int(RATE * length), (length - 3) // Q - 1))


def grams(data: bytes) -> np.ndarray:
    """The q-grams of ``data`` as numbers."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), Q)
    return view.copy().view(np.uint64).ravel()


def banded_distance(pattern: bytes, text: bytes, most: int) -> int:
    """Edits between ``pattern`` and the stretch of ``text`` closest to it, or ``most + 1`` if above ``most``."""
    if pattern in text:
        return 0
    t = np.frombuffer(text, np.uint8)
    row, steps = np.zeros(len(t) + 1, np.int32), np.arange(len(t) + 1, dtype=np.int32)
    for k, c in enumerate(pattern, 1):
        nxt = np.empty_like(row)
        nxt[0] = k
        np.minimum(row[:-1] + (t != c), row[1:] + 1, out=nxt[1:])
        row = np.minimum.accumulate(nxt - steps) + steps
        if row.min() > most:
            return most + 1
    return int(min(row.min(), most + 1))


@dataclass
class Index:
    """The q-grams of one part of the benchmark with their postings."""

    items: list  # item id of each segment
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    codes: np.ndarray
    begin: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    whole: dict

    @staticmethod
    def build(rows: list[tuple]) -> Index:
        items, texts, whole, counts = [], [], {}, {}
        for item, text in rows:
            body = normal(text)
            if not body:
                continue
            if len(body) < SHORT:
                whole.setdefault(body, []).append(item)
                continue
            for part in segments(body):
                items.append(item)
                texts.append(part)
        edits = np.array([budget(len(t)) for t in texts], np.int64)
        needed = np.array([len(t) + 1 - Q * (k + 1) for t, k in zip(texts, edits)], np.int64)
        every = [grams(t) for t in texts]
        codes = np.concatenate(every) if every else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(e) for e in every])
        offset = np.concatenate([np.arange(len(e)) for e in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(codes, kind="stable")
        distinct, begin = np.unique(codes[order], return_index=True)
        return Index(items, texts, edits, needed, distinct, np.append(begin, len(codes)), owner[order].astype(np.int64),
                     offset[order].astype(np.int64), whole)

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, bool)
        out[(self.codes * _SPREAD) >> np.uint64(64 - BITS)] = True
        return out

    def regions(self, data: bytes, table: np.ndarray) -> list[tuple[int, int]]:
        """``segment, first diagonal`` of each band that holds as many shared q-grams as the lemma asks."""
        if not len(self.codes):
            return []
        codes = grams(data)
        at = np.flatnonzero(table[(codes * _SPREAD) >> np.uint64(64 - BITS)])
        where = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        hit = self.codes[where] == codes[at]
        at, where = at[hit], where[hit]
        # a stretch long enough for any segment must hold the smallest count any segment needs
        least, span = int(self.needed.min()), int(max(map(len, self.texts)) + self.edits.max())
        if len(at) < least:
            return []
        dense = at[least - 1:] - at[:len(at) - least + 1] <= span
        if not dense.any():
            return []
        cover = np.zeros(len(at) + 1, np.int64)
        first = np.flatnonzero(dense)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + least, -1)
        keep = np.cumsum(cover[:-1]) > 0
        at, where = at[keep], where[keep]
        many = self.begin[where + 1] - self.begin[where]
        post = np.repeat(self.begin[where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        owner = self.owner[post]
        diagonal = np.repeat(at, many) - self.offset[post] + (1 << 12)
        width = self.edits[owner] + 1
        band = diagonal // width
        key = np.concatenate((owner << 32 | band, owner << 32 | np.maximum(band - 1, 0)))  # bands of two widths overlap
        found, counts = np.unique(key, return_counts=True)
        owner, band = found >> 32, found & 0xFFFFFFFF
        good = counts >= self.needed[owner]
        return [(int(o), int(b * (self.edits[o] + 1) - (1 << 12))) for o, b in zip(owner[good], band[good])]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        table = index.table()
        for batch in batches:
            ids, rows, held, spans, size = batch.column(0), [], [], [], 0
            texts = pc.fill_null(batch.column(1), "")

            def flush() -> None:
                data = b"".join(held)
                ends = np.cumsum([len(h) for h in held])
                best: dict = {}
                for owner, diagonal in index.regions(data, table):
                    most, part = int(index.edits[owner]), index.texts[owner]
                    middle = diagonal + len(part) // 2
                    slot = min(int(np.searchsorted(ends, max(0, middle), "right")), len(held) - 1)
                    left, right = int(ends[slot]) - len(held[slot]), int(ends[slot])
                    lo = max(left, diagonal - most)
                    hi = min(right, diagonal + 2 * (most + 1) + len(part) + most)
                    edits = banded_distance(part, data[lo:hi], most)
                    if edits <= most:
                        key = (spans[slot], owner)
                        best[key] = min(edits, best.get(key, edits))
                rows.extend((k, owner, edits) for (k, owner), edits in best.items())

            for k in range(len(batch)):
                body = normal(texts[k].as_py())
                for item in index.whole.get(body, ()):
                    rows.append((k, -1, item))
                held += [body, b"\x00" * Q]
                spans += [k, k]
                size += len(body)
                if size > CHUNK:
                    flush()
                    held, spans, size = [], [], 0
            if held:
                flush()
            yield pa.record_batch(
                [ids.take(pa.array([r[0] for r in rows], pa.int64())),
                 pa.array([r[2] if r[1] < 0 else index.items[r[1]] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([0 if r[1] < 0 else r[2] for r in rows], pa.int64())],
                ["doc_id", "item_id", "segment", "edits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, segments, edits``: every item of which a document holds a segment within its budget.

    ``segments`` counts different ones, ``edits`` sums the fewest of each. Null and empty texts and items match
    nothing; a null item id stays null. Items shorter than ``SHORT`` match only texts equal to them.
    Repeated ids count as one document. An empty table on either side gives no rows.

    The benchmark is searched in parts of at most ``INDEX_BYTES``, so what is broadcast does not grow with it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t"))
    held = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-held // INDEX_BYTES))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for part in range(parts):
        index = Index.build([tuple(r) for r in items.filter(
            F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).orderBy("i", "t").collect()])
        one = rows.mapInArrow(_search(spark.sparkContext.broadcast(index)),
                              "doc_id long, item_id long, segment long, edits long").withColumn("part", F.lit(part))
        found = one if found is None else found.union(one)
    return found.groupBy("doc_id", "item_id", "part", "segment").agg(F.min("edits").alias("edits")).groupBy(
        "doc_id", "item_id").agg(F.count("*").alias("segments"), F.sum("edits").alias("edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a benchmark segment; rows with a null id stay."""
    bad = staged(contamination(docs.filter(F.col(key).isNotNull()), benchmark, text, key).select(
        F.col("doc_id").alias("__id")).distinct(), "leaks")
    return docs.join(bad, F.col(key) == F.col("__id"), "left_anti")
