"""Packing of tokenized documents into sequences of like cost, where attention costs the square of a piece's length."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.packing import END_ID, merges_by_id, token_ids

#: Tokens that a task packs together: 16 MB of ids. A longer document makes its window longer.
WINDOW_TOKENS = 1 << 22
#: Cost of a piece of n tokens: LINEAR * n + SQUARE * n * n, with the token's share of all layers as the unit.
LINEAR, SQUARE = 1.0, 1 / 2048


def piece_cost(length: int) -> float:
    return LINEAR * length + SQUARE * length * length


class OpenSequences:
    """Sequences by remaining room; a tree over rooms finds the cheapest that takes a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.leaves)]
        self.least: list[tuple[float, int, int] | None] = [None] * (2 * self.leaves)

    def _update(self, room: int) -> None:
        heap, node = self.heaps[room], room + self.leaves
        self.least[node] = (*heap[0], room) if heap else None
        while node > 1:
            node //= 2
            a, b = self.least[2 * node], self.least[2 * node + 1]
            self.least[node] = b if a is None else a if b is None else min(a, b)

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._update(room)

    def take(self, length: int) -> tuple[float, int, int] | None:
        """Cost, number and room of the cheapest sequence with room for ``length``, which is then closed."""
        low, high, best = length + self.leaves, 2 * self.leaves, None
        while low < high:
            if low & 1:
                best = min(filter(None, (best, self.least[low])), default=None)
                low += 1
            low, high = low // 2, high // 2
        if best:
            heapq.heappop(self.heaps[best[2]])
            self._update(best[2])
        return best

    def roomiest(self) -> tuple[float, int, int]:
        """The same for the largest room left, the cheapest of equal ones."""
        node = 1
        while node < self.leaves:
            node = 2 * node + (self.least[2 * node + 1] is not None)
        return self.take(node - self.leaves)


def capacities(tokens: int, size: int) -> list[int]:
    """Full sequences for ``tokens`` and, for the rest, shorter ones of a power of two each, which need no padding."""
    rest = tokens % size
    return [size] * (tokens // size) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def balanced(lengths: list[int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` that fill all ``capacities`` to the last token.

    Documents longer than ``size`` give pieces of ``size`` first. Then the longest piece goes to the
    cheapest sequence that has room for it. Where none has, it is cut: its head fills the largest room
    left, its rest is a piece like others.
    """
    filled = capacities(sum(lengths), size)
    bins = OpenSequences(size)
    for k, room in enumerate(filled):
        bins.put(room, 0.0, k)
    waiting = [(-min(size, n - at), k, at) for k, n in enumerate(lengths) for at in range(0, n, size)]
    heapq.heapify(waiting)
    placed = []
    while waiting:
        length, k, start = heapq.heappop(waiting)
        length = -length
        found = bins.take(length) or bins.roomiest()
        cost, sequence, room = found
        part = min(length, room)
        placed.append((k, start, part, sequence, filled[sequence] - room))
        bins.put(room - part, cost + piece_cost(part), sequence)
        if part < length:
            heapq.heappush(waiting, (part - length, k, start + part))
    return placed


def pack_balanced(docs: DataFrame, path: str, size: int = 1024, window: int = WINDOW_TOKENS, text: str = "text",
                  key: str = "doc_id") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece of every row of ``docs``.

    A document is the ids of its text by the tokenizer at ``path`` (null: empty) and one end id. Each task
    packs its rows in windows of about ``window`` tokens, without a shuffle; tokens that do not fill the
    last sequence of a window wait for the next one. All sequences are full but the last of a task, which
    are powers of two, so nothing is padded. Repeated rows are packed as often as they occur, a null id
    stays null, no rows give no rows. Sequence numbers hold the task's number in their upper bits.
    """
    by_id, end = merges_by_id(path), END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, int, int, bytes]] = []  # id, tokens of the document, start, ids from there

        def packed(last: bool) -> pa.RecordBatch:
            nonlocal number
            lengths, over = [len(h[3]) // 4 for h in held], []
            rest = 0 if last else sum(lengths) % size
            while rest:  # the tail of the window's last documents waits
                cut = min(rest, lengths[-1])
                lengths[-1] -= cut
                rest -= cut
                doc, n, start, ids = held[len(lengths) - 1]
                over.append((doc, n, start + lengths[-1], ids[4 * lengths[-1]:]))
                if not lengths[-1]:
                    lengths.pop()
            pieces = balanced(lengths, size)
            table = np.array(pieces, np.int64).reshape(-1, 5)
            crc = [zlib.crc32(held[k][3][4 * at:4 * (at + n)]) for k, at, n, _, _ in pieces]
            of = [held[k] for k in table[:, 0].tolist()]
            out = pa.record_batch([
                pa.array([h[0] for h in of], pa.int64()), pa.array(table[:, 1] + np.array([h[2] for h in of], np.int64)),
                pa.array(table[:, 2]), pa.array(crc, pa.int64()), pa.array([h[1] for h in of], pa.int64()),
                pa.array(table[:, 3] + number), pa.array(table[:, 4])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            number += len(capacities(sum(lengths), size))
            held[:] = over
            return out

        gathered = 0
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                for doc, ids in zip(batch.column(0).to_pylist(), token_ids(texts, path, by_id)):
                    ids += end
                    held.append((doc, len(ids) // 4, 0, ids))
                    gathered += len(ids) // 4
                    if gathered >= window:
                        yield packed(False)
                        gathered = sum(len(h[3]) // 4 for h in held)
        if held:
            yield packed(True)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
