"""Shared pieces: scratch tables, held-out splits, word and shingle hashes over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="veilframe-")
    return f"{base.rstrip('/')}/veilframe/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by ``staged`` that no later step reads."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session.sparkContext().hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str)
                   else doc_id.cast("string").cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- hashing over Arrow text ------------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * GOLDEN
    return h ^ (h >> np.uint64(32))


_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = int(_RANDOM.integers(0, 2**63)) * 2 + 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            values = np.full(size, base, np.uint64)
            values[0] = 1
            _POWERS[k] = np.cumprod(values)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: first row, end row, their bytes, their bounds in these bytes.

    Null counts as empty. A text is never cut, so one longer than ``limit`` is a run of its own.
    """
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
        yield start, end, data[bounds[start]:bounds[end]], bounds[start:end + 1] - bounds[start]
        start = end


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, and how many words each row has.

    Words are runs of bytes other than space and 0x09-0x0D; A-Z counts as a-z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([True], ~word[:-1])) | edge[:-1]
    after = np.concatenate((~word[1:], [True])) | edge[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    powers, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    counts = np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])
    return hashes, counts


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row; fewer words than ``size`` make one shingle, none make none."""
    hashes, counts = word_hashes(data, bounds)
    many = max(0, len(hashes) - size + 1)
    joined = hashes[:many].copy()
    for k in range(1, size):
        joined = mix(joined * GOLDEN + hashes[k:k + many])
    at = 0
    for count in counts:
        if count >= size:
            yield np.unique(joined[at:at + count - size + 1])
        elif count:
            one = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[at:at + count]:
                    one = mix(np.asarray(one * GOLDEN + h))[()]
            yield np.array([one], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += count


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
