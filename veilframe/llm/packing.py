"""Best-fit decreasing packing of tokenized documents, with a segment tree over remaining capacities."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

END_ID = 0
#: How byte-level tokenizers cut a text before merging.
_CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_state: dict = {}


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free one above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merges_by_id(path: str) -> bool:
    """Whether the tokenizer file is plain byte-level BPE whose merges follow the order of ids.

    Then merging by id gives the same ids as merging by pair: no merge crosses the ends of a token before all
    lower ones inside it are done, and each token is what its own characters merge to.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if (model.get("type") != "BPE" or any(model.get(k) for k in odd) or spec.get("normalizer")
            or spec.get("truncation") or spec.get("padding")
            or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True)):
        return False
    vocabulary, added = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if made != sorted(set(made)) or not set(_byte_characters()) <= set(vocabulary):
        return False
    merge = Tokenizer.from_file(path).model.tokenize
    return all([t.id for t in merge(word)] == [k] for word, k in vocabulary.items() if word not in added)


def _encoders(path: str, by_id: bool):
    """The tokenizer of the file, its fast twin (or None), and a pattern of its added tokens (or None); one per worker."""
    from tokenizers import Tokenizer

    if _state.get("key") != (path, by_id):
        import tiktoken

        tokenizer, fast = Tokenizer.from_file(path), None
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        if by_id:
            with open(path, encoding="utf-8") as file:
                vocabulary = json.load(file)["model"]["vocab"]
            byte = _byte_characters()
            fast = tiktoken.Encoding("pieces", pat_str=_CUTS, special_tokens={}, mergeable_ranks={
                bytes(byte[c] for c in word): k for word, k in vocabulary.items() if word not in added})
        _state.update(key=(path, by_id), made=(tokenizer, fast, re.compile("|".join(map(re.escape, added))) if added else None))
    return _state["made"]


def token_ids(texts: list[str], path: str, by_id: bool) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, without special tokens added.

    ``by_id`` is what ``merges_by_id`` says of the file. Such texts are merged by id, which takes half the
    time; those that spell an added token, and all texts of other files, go through the tokenizer itself.
    """
    tokenizer, fast, added = _encoders(path, by_id)
    for text in texts:
        if fast is None or (added and added.search(text)):
            yield array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            yield fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def pieces(docs: DataFrame, path: str, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, place``; place counts a partition's pieces of one length."""
    end, by_id = END_ID.to_bytes(4, "little"), merges_by_id(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                doc, row = batch.column(0), []
                for k, ids in enumerate(token_ids(pc.fill_null(batch.column(1), "").to_pylist(), path, by_id)):
                    ids += end
                    n = len(ids) // 4
                    begin, piece = 0, 0
                    stop = n % size or min(n, size)
                    while begin < n:
                        length = stop - begin
                        row.append((k, piece, begin, length, zlib.crc32(ids[4 * begin:4 * stop]), seen[length]))
                        seen[length] += 1
                        begin, stop, piece = stop, stop + size, piece + 1
                out = np.array(row, np.int64).reshape(-1, 6)
                yield pa.record_batch([doc.take(pa.array(out[:, 0])), pa.array(out[:, 1].astype(np.int32)),
                                       pa.array(out[:, 2]), pa.array(out[:, 3]), pa.array(out[:, 4]),
                                       pa.array(np.full(len(out), part, np.int32)), pa.array(out[:, 5])],
                                      ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


class OpenBins:
    """Open bins by remaining capacity; a segment tree finds the tightest that takes a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def _mark(self, room: int) -> None:
        node = room + self.leaves
        self.any[node] = bool(self.groups[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def put(self, room: int, first: int, count: int) -> None:
        if count and room:
            self.groups[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        group = self.groups[room].pop()
        self._mark(room)
        return group

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least ``length``, or 0."""
        node = length + self.leaves
        if self.any[node]:
            return length
        while node > 1:
            if not node & 1 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return 0


def best_fit_plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over lengths with multiplicity.

    Items of one length are alike, so equal bins are kept as runs ``(first bin, count)`` and filled
    together: the plan has at most a few runs per length, however many items there are. Rows:
    length, first item rank, items per bin, first bin, offset of the first item.
    """
    bins, opened, plan = OpenBins(size), 0, []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = bins.tightest(length)
            if room:
                first, count = bins.take(room)
            else:
                room, first, count = size, opened, -(-left // (size // length))
                opened += count
            each = room // length  # after one item such a bin is the tightest until it is full
            full = min(count, left // each)
            if full:
                plan.append((length, rank, each, first, size - room))
                bins.put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if count > full:
                some = left if left < each else 0
                if some:
                    plan.append((length, rank, some, first + full, size - room))
                    bins.put(room - some * length, first + full, 1)
                    rank, left = rank + some, 0
                bins.put(room, first + full + bool(some), count - full - bool(some))
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one row per piece of every row of ``docs``.

    A document is the ids of its text by the tokenizer at ``path`` (null: empty) and one end id. Those
    longer than ``size`` are cut into pieces of ``size``, of which the first may be shorter. Repeated
    rows are packed as often as they occur; a null id stays null; no rows give no rows.

    The driver sees at most ``size`` counts, one per length, and the plan has a few runs per length. Ranks
    within a length come from each partition's own count plus a running total over partitions, so no
    task holds all items of a frequent length.
    """
    cut = staged(pieces(docs, path, size, text, key), "pieces")
    tally = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    tally = staged(tally, "tally")
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_plan(counts, size)
    big = np.int64(1) << 48
    keys = plan[:, 0] * big + plan[:, 1]

    before = tally.selectExpr("length", "part", "n", "sum(n) over (partition by length order by part "
                              "rows between unbounded preceding and current row) - n as earlier").drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(keys, np.arange(0)) if not len(rank) else np.searchsorted(
                keys, length * big + rank, "right") - 1
            _, first_rank, each, first_bin, offset = plan[run].T if len(rank) else np.zeros((5, 0), np.int64)
            within = rank - first_rank
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            each = np.maximum(each, 1)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(first_bin + within // each),
                                   pa.array(offset + within % each * length)], [*names, "sequence_id", "offset"])

    order = np.argsort(keys, kind="stable")
    plan, keys = plan[order], keys[order]
    return cut.join(before, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("place")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
