"""Near-duplicate documents: many universal hash minima, banding, verification on full sets, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import lists, mix, shingle_sets, signed, staged, text_chunks
from veilframe.llm.components import components

ROWS = 5
#: Probability that a pair exactly at the threshold shares no band.
MISS = 1e-5
#: Documents and shingles that one side of a verification task holds at most, on average.
BLOCK_DOCS, BLOCK_SHINGLES = 200, 400_000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """As many bands as keep the loss at the threshold below ``miss``."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999999) ** rows)))


def band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """One key per band, from the minima of ``a * x + b`` modulo 2**64."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = a[:, None] * shingles[None, at:at + 4096]
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    least = least.reshape(-1, rows)
    key = np.arange(len(least), dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(31) + least[:, k])
    return key


def signatures(docs: DataFrame, size: int, threshold: float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands``: the set's size, a 128-bit sum of the set, its band keys."""
    bands = bands_for(threshold)
    random = np.random.default_rng(7)
    a = random.integers(0, 2**64, bands * ROWS, dtype=np.uint64) | np.uint64(1)
    b = random.integers(0, 2**64, bands * ROWS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, bounds in text_chunks(batch.column(1)):
                counts, sums, others, keys = [], [], [], []
                for found in shingle_sets(data, bounds, size):
                    counts.append(len(found))
                    sums.append(np.sum(mix(found), dtype=np.uint64))
                    others.append(np.sum(mix(found ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
                    keys.append(signed(band_keys(found, a, b, ROWS)) if len(found) else np.zeros(0, np.int64))
                yield pa.record_batch([ids.slice(start, end - start), pa.array(counts, pa.int64()),
                                       pa.array(signed(np.array(sums, np.uint64))),
                                       pa.array(signed(np.array(others, np.uint64))), lists(keys, pa.int64())],
                                      ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets (of one list with itself where right is None)."""
    both = left if right is None else left + right
    where = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, column, times = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    where, column = where[keep], (np.cumsum(times > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    where, column = where[order], column[order]
    n, cut = len(both), len(left) if right is not None else 0
    out = np.zeros((len(left), n - cut), np.float32)
    width, total = 8192, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        hot = np.zeros((n, min(width, total - at)), np.float32)
        hot[where[lo:hi], column[lo:hi] - at] = 1
        out += hot[:len(left)] @ hot[cut:].T
    return out


def forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """One edge per node to the smallest id of its component in a symmetric link matrix."""
    order = np.argsort(ids, kind="stable")
    seen, out = np.zeros(len(ids), bool), []
    for first in order:
        if seen[first]:
            continue
        seen[first], front = True, np.array([first])
        while len(front):
            near = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[near] = True
            out += [(int(ids[k]), int(ids[first])) for k in near]
            front = near
    return out


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        block = group.column("block").to_numpy()
        sets = [np.asarray(s, np.int64).view(np.uint64) for s in
                (x.values.to_numpy(zero_copy_only=False) for x in group.column("shingles"))]
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        size = np.array([len(s) for s in sets], np.float64)
        linked = np.zeros((len(ids), len(ids)), bool)
        if lo == hi:
            parts = [(np.arange(len(ids)), None)]
        else:
            parts = [(np.flatnonzero(block == lo), np.flatnonzero(block == hi))]
        for one, two in parts:
            other = one if two is None else two
            if len(one) and len(other):
                shared = shared_counts([sets[k] for k in one], None if two is None else [sets[k] for k in two])
                union = size[one][:, None] + size[other][None, :] - shared
                linked[np.ix_(one, other)] = 100 * shared >= percent * union
        edges = forest(linked | linked.T, ids)
        return pa.table({"u": pa.array([e[0] for e in edges], pa.int64()),
                         "v": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for start, end, data, bounds in text_chunks(batch.column("text")):
                found = [signed(s) for s in shingle_sets(data, bounds, size)]
                part = rest.slice(start, end - start)
                yield pa.record_batch([*part.columns, lists(found, pa.int64())], [*part.schema.names, "shingles"])

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two texts are linked when their sets of ``size``-word shingles overlap by at least ``percent`` per
    cent of their union. A text of fewer words is one shingle; null, empty and blank texts have no
    set and link with nothing. ``component_id`` is the smallest ``doc_id`` reachable; only that row is
    ``kept``. Rows with a null id get a null component and are kept. Repeated ids give repeated rows.

    Equal sets collapse into one representative before any candidate search, so exact copies cost one
    row each. Bands put representatives into buckets; a bucket contributes a star, not its pairs.
    The components of these stars are candidate clusters: any two texts that share a band lie in one.
    Inside a cluster all full sets are compared, exactly and in blocks: a large cluster is
    hashed into blocks and every pair of blocks is a task of bounded size that returns a spanning
    forest of its links, never the pairs themselves.
    """
    threshold = percent / 100
    sigs = staged(signatures(docs, size, threshold, text, key), "signatures")
    known = sigs.filter("doc_id is not null and n_shingles > 0")
    reps = staged(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    banded = (known.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
              .select("doc_id", F.explode("bands").alias("band")))
    hubs = banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).filter("hub < top")
    stars = banded.join(hubs, "band").filter("doc_id <> hub").select("doc_id", "hub").distinct()
    clusters = staged(components(stars), "clusters")

    sized = clusters.join(known.select(F.col("doc_id").alias("node"), "n_shingles"), "node")
    weights = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select(
        "root", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = staged(clusters.join(weights, "root").select(
        F.col("node").alias("doc_id"), "root", "blocks",
        F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "members")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = texts.join(members, "doc_id").mapInArrow(
        _sets(size), "doc_id long, root long, blocks int, block int, shingles array<long>")
    tasks = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "doc_id", "root", "block", "shingles",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    links = tasks.groupBy("root", "lo", "hi").applyInArrow(_verify(percent), "u long, v long")
    found = components(links)

    classes = reps.join(found, reps.rep == found.node, "left").select(
        "set_a", "set_b", F.coalesce("root", "rep").alias("component"))
    return (sigs.drop("bands").join(classes, ["set_a", "set_b"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
                    .alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
