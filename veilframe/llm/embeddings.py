"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import lists, mix, signed, staged
from veilframe.llm.components import components
from veilframe.llm.minhash import forest

#: Tables, hashes joined per table, buckets per table and vector (its own and the likeliest others).
TABLES, HASHES, PROBES = 14, 3, 3
#: Vectors on each side of a verification task, on average.
BLOCK = 256
#: Buckets of so many rows are compared together, larger ones one by one; rows that a task compares at a time.
SMALL, RUN_ROWS = 24, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width, step = len(x), x.shape[1], 1
    while step < width:
        pairs = x.reshape(n, -1, 2, step)
        x = np.concatenate((pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def buckets(unit: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket keys, ``tables * probes`` per row: the nearest signed axes of each rotation, joined per table.

    A probe replaces the axis whose lead over its runner-up is smallest; the next probe the second
    smallest, and so on.
    """
    n, dim = unit.shape
    width = 1 << max(0, dim - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :dim] = unit
    out = np.zeros((n, tables, probes), np.uint64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, lead = (np.zeros((n, hashes), kind) for kind in (np.int64, np.int64, np.float64))
        for h in range(hashes):
            random = np.random.default_rng((97, dim, t, h))
            x = padded
            for _ in range(3):
                x = hadamard(x * random.choice((-1.0, 1.0), width))
            size = np.abs(x)
            first = size.argmax(axis=1)
            top = size[rows, first]
            size[rows, first] = -1
            next_ = size.argmax(axis=1)
            best[:, h] = first * 2 + (x[rows, first] < 0)
            second[:, h] = next_ * 2 + (x[rows, next_] < 0)
            lead[:, h] = top - size[rows, next_]
        order = np.argsort(lead, axis=1, kind="stable")
        for p in range(probes):
            axes = best.copy()
            if p:
                swap = order[:, (p - 1) % hashes]
                axes[rows, swap] = second[rows, swap]
            key = np.full(n, t * 1000003 + dim, np.uint64)
            for h in range(hashes):
                key = mix(key * np.uint64(1315423911) + axes[:, h].astype(np.uint64))
            out[:, t, p] = key
    return out.reshape(n, tables * probes)


def _hash(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                ids, column = batch.column(0), batch.column(1)
                values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                sizes = np.array([-1 if s is None else s for s in column.value_lengths().to_pylist()])
                begin = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
                codes = [np.zeros(0, np.int64)] * len(batch)
                class_a, class_b = np.zeros(len(batch), np.uint64), np.zeros(len(batch), np.uint64)
                for dim in np.unique(sizes[sizes > 0]):
                    rows = np.flatnonzero(sizes == dim)
                    x = values[begin[rows][:, None] + np.arange(dim)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        scale = np.abs(x).max(axis=1)
                        good = np.isfinite(x).all(axis=1) & (scale > 0)
                    rows, x, scale = rows[good], x[good] + 0.0, scale[good]
                    if not len(rows):
                        continue
                    unit = x / scale[:, None]
                    unit /= np.linalg.norm(unit, axis=1)[:, None]
                    keys = buckets(unit, tables, hashes, probes)
                    for k, row in enumerate(rows):
                        codes[row] = signed(np.unique(keys[k]))
                    bits = np.ascontiguousarray(x).view(np.uint64)
                    with np.errstate(over="ignore"):
                        for salt, out in ((np.uint64(dim), class_a), (np.uint64(dim) ^ np.uint64(0xABCDEF), class_b)):
                            h = np.full(len(x), salt, np.uint64)
                            for d in range(dim):
                                h = mix(h * np.uint64(0x100000001B3) + bits[:, d])
                            out[rows] = h
                yield pa.record_batch([ids, pa.array(signed(class_a)), pa.array(signed(class_b)), lists(codes, pa.int64())],
                                      ["vec_id", "class_a", "class_b", "codes"])

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))


def _rows_of(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows one after the other, and which of them each belongs to."""
    size = bounds[rows + 1] - bounds[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return values[np.repeat(bounds[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())], owner


class Buckets:
    """Rows of whole buckets (or pairs of blocks of one), which lie together: their links, each in one bucket only."""

    def __init__(self, table: pa.Table, cosine: float):
        column = lambda name: table.column(name).combine_chunks().to_numpy()
        self.ids, self.block, self.weight = column("vec_id"), column("block"), column("weight")
        keys = [column(name) for name in ("bucket", "lo", "hi")]
        self.split = keys[1] != keys[2]  # two blocks of a bucket: only pairs across them
        new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
        self.group, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.size = np.diff(np.r_[self.first, len(self.ids)])
        self.codes, self.code_bounds = _flat(table.column("lower"))
        values, bounds = _flat(table.column("embedding"))
        dims, self.cosine = np.diff(bounds), cosine
        self.unit = np.zeros((len(self.ids), dims.max()))
        for dim in np.unique(dims):  # vectors of a bucket have one length
            rows = np.flatnonzero(dims == dim)
            x = values[bounds[rows][:, None] + np.arange(dim)].astype(np.float64)
            x /= np.abs(x).max(axis=1)[:, None]
            self.unit[rows, :dim] = x / np.linalg.norm(x, axis=1)[:, None]

    def _counted_here(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs share no smaller bucket than this one."""
        here = np.ones(len(one), bool)
        for at in range(0, len(one), 65536):
            part = slice(at, at + 65536)
            left, owner = _rows_of(self.codes, self.code_bounds, one[part])
            right, other = _rows_of(self.codes, self.code_bounds, two[part])
            both = np.concatenate((np.stack((owner, left), 1), np.stack((other, right), 1)))
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            here[at + both[1:][(both[1:] == both[:-1]).all(axis=1), 0]] = False
        return here

    def small(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of buckets of up to ``SMALL`` rows, by comparing all rows with those some places on."""
        found = []
        for step in range(1, min(SMALL, int(self.size.max(initial=1)))):
            i = np.flatnonzero((self.size[self.group[:-step]] <= SMALL) & (self.group[:-step] == self.group[step:])
                               & (~self.split[:-step] | (self.block[:-step] != self.block[step:])))
            for at in range(0, len(i), 8192):
                part = i[at:at + 8192]
                near = np.einsum("nd,nd->n", self.unit[part], self.unit[part + step]) >= self.cosine
                found.append(np.stack((part[near], part[near] + step)))
        one, two = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        here = self._counted_here(one, two)
        return one[here], two[here]

    def large(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of bucket ``k`` that have links, and their matrix of links."""
        rows = np.arange(self.first[k], self.first[k] + self.size[k])
        linked = self.unit[rows] @ self.unit[rows].T >= self.cosine
        if self.split[rows[0]]:
            linked &= self.block[rows][:, None] != self.block[rows][None, :]
        np.fill_diagonal(linked, False)
        some = linked.any(axis=1)
        rows, linked = rows[some], linked[np.ix_(some, some)]
        if len(rows):
            code, owner = _rows_of(self.codes, self.code_bounds, rows)
            _, column, times = np.unique(code, return_inverse=True, return_counts=True)
            often = np.flatnonzero(times > 1)
            place = np.full(len(times), -1)
            place[often] = np.arange(len(often))
            column = place[column]
            for at in range(0, len(often), 4096):  # links that share a smaller bucket are counted there
                mine = (column >= at) & (column < at + 4096)
                hot = np.zeros((len(rows), min(4096, len(often) - at)), np.float32)
                hot[owner[mine], column[mine] - at] = 1
                linked &= hot @ hot.T == 0
        return rows, linked

    def links(self) -> pa.Table:
        added, edges = np.zeros(len(self.ids), np.int64), []
        one, two = self.small()
        np.add.at(added, one, self.weight[two])
        np.add.at(added, two, self.weight[one])
        many = np.bincount(self.group[one], minlength=len(self.size)) > self.size
        for k in np.flatnonzero(many):  # a bucket gives at most as many edges as it has rows
            mine = self.group[one] == k
            rows = np.arange(self.first[k], self.first[k] + self.size[k])
            linked = np.zeros((len(rows), len(rows)), bool)
            linked[one[mine] - rows[0], two[mine] - rows[0]] = linked[two[mine] - rows[0], one[mine] - rows[0]] = True
            edges += forest(linked, self.ids[rows])
        few = ~many[self.group[one]]
        edges += list(zip(self.ids[one[few]].tolist(), self.ids[two[few]].tolist()))
        for k in np.flatnonzero(self.size > SMALL):
            rows, linked = self.large(k)
            if len(rows):
                added[rows] += linked @ self.weight[rows]
                edges += forest(linked, self.ids[rows])
        some = np.flatnonzero(added)
        own, n = self.ids[some], added[some]
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(np.r_[own, ends[:, 0]]), "v": pa.array(np.r_[own, ends[:, 1]]),
                         "links": pa.array(np.r_[n, np.zeros(len(ends), np.int64)])})


def _verify(cosine: float):
    """Links of rows that come sorted by bucket, a bounded run of whole buckets at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.Table:
            table = pa.Table.from_batches(held)
            held.clear()
            return table

        def key(batch: pa.RecordBatch, row: int) -> list:
            return [batch.column(c)[row].as_py() for c in ("bucket", "lo", "hi")]

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < RUN_ROWS or key(held[0], 0) == key(batch, len(batch) - 1):
                continue
            table = whole()
            last = [table.column(c).combine_chunks().to_numpy() for c in ("bucket", "lo", "hi")]
            cut = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in last]))[-1]) + 1
            yield from Buckets(table.slice(0, cut), cosine).links().to_batches()
            held.extend(table.slice(cut).to_batches())
        if held:
            yield from Buckets(whole(), cosine).links().to_batches()

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, tables: int = TABLES, hashes: int = HASHES,
                 probes: int = PROBES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows whose cosine, in double precision, is at least ``cosine`` and
    that share a bucket; ``component_id`` is the smallest id reachable by such links, only that row is
    ``kept``. Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing,
    nor do vectors of different length. Rows with a null id have no links, a null component, and are kept.

    Equal vectors become one representative with a weight. A bucket of many representatives is hashed
    into blocks and each pair of blocks is one bounded task; it returns sums per vector and a
    spanning forest, not pairs. A pair is counted in the smallest bucket that both share.
    """
    kept = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    hashed = staged(kept.mapInArrow(
        _hash(tables, hashes, probes), "vec_id long, class_a long, class_b long, codes array<long>"), "vectors")
    known = hashed.filter("vec_id is not null and size(codes) > 0")
    classes = staged(known.groupBy("class_a", "class_b").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("vec_id"), "weight", "class_a", "class_b"),
                      ["vec_id", "class_a", "class_b"]).dropDuplicates(["vec_id"])
    slots = reps.select("vec_id", F.explode("codes").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select(
        "bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    places = slots.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "vec_id", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    native = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    if "float" not in vectors.schema[vector].dataType.simpleString():
        native = native.withColumn("embedding", F.col("embedding").cast("array<double>"))
    lone = native.join(reps.select("vec_id", "weight", "codes"), "vec_id").filter(
        "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = places.join(lone, "vec_id").withColumn("lower", F.expr("filter(codes, c -> c < bucket)")).drop("codes", "other")
    links = staged(rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select(
        "vec_id", "bucket", "block", "lo", "hi", "embedding", "weight", "lower").mapInArrow(
        _verify(cosine), "u long, v long, links long"), "links")
    found = components(links.select("u", "v"))
    counts = links.groupBy("u").agg(F.sum("links").alias("links")).filter("links > 0")
    answer = classes.join(counts, classes.rep == counts.u, "left").join(found, classes.rep == found.node, "left").select(
        "class_a", "class_b", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
        F.coalesce("root", "rep").alias("c"))
    valid = F.col("vec_id").isNotNull() & (F.size("codes") > 0)
    return (hashed.join(answer, ["class_a", "class_b"], "left")
            .select("vec_id", F.when(valid, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
                    F.when(valid, F.coalesce("c", "vec_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
