"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text, compared window by window."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import mix, text_chunks

#: Bytes of a window and between windows.
WINDOW, STRIDE = 64, 40
#: Labelled texts the fit reads at most, for each label.
SAMPLE = 3_000
#: Bytes of the ordinary and of the toxic dictionary.
PLAIN_BYTES, TOXIC_BYTES = 24_000, 6_000
#: A run of bytes marks toxic text if it is so many times as frequent there, and its log-likelihood ratio so large.
ODDS, EVIDENCE = 8.0, 12.0
#: Bytes of all the texts of one label that the fit holds at most; texts come in the order of their hash.
SAMPLE_BYTES = 24 << 20
LEVEL = 6
NAMES = ("largest", "third", "tenth", "excess", "windows")


def window_bounds(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of texts that lie at ``bounds``, and how many each text has.

    Windows cover whole texts; the last of a text ends with it. Texts without bytes have none.
    """
    size = np.diff(bounds)
    count = np.where(size > 0, np.maximum(-(-(size - WINDOW) // STRIDE), 0) + 1, 0)
    first = np.repeat(bounds[:-1], count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    end = np.repeat(bounds[1:], count)
    start = np.maximum(np.minimum(first + step * STRIDE, end - WINDOW), first)
    return np.stack((start, np.minimum(end - start, WINDOW)), axis=1), count


class Coder:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes):
        prepared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prepared.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=prepared, write_content_size=False,
                                                   write_checksum=False, write_dict_id=False)

    def lengths(self, data: bytes, windows: np.ndarray) -> np.ndarray:
        if not len(windows):
            return np.zeros(0)
        parts = zstandard.BufferWithSegments(data, np.ascontiguousarray(windows, np.uint64).tobytes())
        return np.fromiter(map(len, self.compressor.multi_compress_to_buffer(parts, threads=1)), np.float64, len(windows))


def lowered(data: np.ndarray) -> bytes:
    return data.tobytes().lower()


def features(gain: np.ndarray, count: np.ndarray, tau: float) -> np.ndarray:
    """Of each text: order statistics of its windows' gains, and the sum of what exceeds ``tau``.

    ``gain`` is the length under the ordinary dictionary less that under the toxic one. A text without
    windows has zeros.
    """
    out, at = np.zeros((len(count), len(NAMES))), 0
    for k, n in enumerate(count):
        if n:
            own = gain[at:at + n]
            top = np.sort(np.partition(own, max(0, n - 10))[max(0, n - 10):])[::-1]
            out[k] = (top[0], top[min(2, n - 1)], top[min(9, n - 1)],
                      np.log1p(np.maximum(own - tau, 0).sum()), np.log1p(n))
        at += n
    return out


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    tau: float
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.centre) / self.scale @ self.weights + self.bias, -30, 30)))


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    return b"".join(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """A trained dictionary; too few samples to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:].rjust(16)


RUNS = (4, 6, 8)


def _runs(text: bytes) -> np.ndarray:
    """A code for each run of 4, 6 and 8 bytes of a text: one row for each length, one column for each place."""
    padded = np.frombuffer(b" " + text + b" " * 8, np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    return np.stack([mix((eight << np.uint64(64 - 8 * n)) + np.uint64(n)) for n in RUNS])


def _unlike(texts: list[bytes]) -> list[bytes]:
    """Texts without near copies of one another: equal smallest codes stand for likely copies."""
    seen, out = set(), []
    for text in texts:
        codes = _runs(text)[-1]
        if len(codes) > 24:  # runs of 32 bytes: shared by copies, hardly by other texts
            codes = mix(codes[:-24] + mix(codes[8:-16] + mix(codes[16:-8] + mix(codes[24:]))))
        marks = {(k, int(mix(codes * np.uint64(2 * k + 1)).min())) for k in range(8)}
        if not marks & seen:
            out.append(text)
        seen |= marks
    return out


def distinctive(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The passages of toxic texts that consist of runs of bytes far more frequent in toxic than in ordinary texts."""
    toxic = _unlike(toxic)
    codes, counts = np.unique(np.concatenate([np.unique(_runs(t)) for t in toxic]), return_counts=True)
    often = counts >= 4
    codes, counts = codes[often], counts[often]
    if not len(codes):
        return []
    other = np.zeros(len(codes))
    for text in ordinary:
        found = np.unique(_runs(text))
        where = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
        other[where[codes[where] == found]] += 1
    odds = (counts + 0.5) / (len(toxic) + 1) / ((other + 0.5) / (len(ordinary) + 1))
    share = len(toxic) / (len(toxic) + len(ordinary))
    evidence = (counts * np.log(counts / ((counts + other) * share))
                + other * np.log(np.maximum(other, 1) / ((counts + other) * (1 - share))))
    marks = codes[(odds >= ODDS) & (evidence >= EVIDENCE)]
    out = []
    for text in toxic:
        found = _runs(text)
        where = np.minimum(np.searchsorted(marks, found), max(0, len(marks) - 1))
        hit = marks[where] == found if len(marks) else np.zeros(found.shape, bool)
        covered = np.zeros(found.shape[1] + 8, bool)
        for n, row in zip(RUNS, hit):
            for k in range(n):
                covered[k:k + found.shape[1]] |= row
        edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        out += [(b" " + text)[s:e].ljust(12) for s, e in zip(edge[::2], edge[1::2])]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    design = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(design.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + keep + 1e-9 * np.eye(len(w)),
                               design.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
    return w[:-1], float(w[-1])


def fit(toxic: list[bytes], ordinary: list[bytes]) -> Model | float:
    """Train both dictionaries and calibrate, or return a constant score where a label is missing.

    A toxic text is toxic in a few passages only: those with runs of bytes that ordinary texts rarely hold
    train the toxic dictionary. It is put before the ordinary one, so that ordinary windows are as
    long under either and a gain means toxic matter. Two thirds of the texts train the dictionaries, the
    others calibrate thresholds and weights.
    """
    toxic, ordinary = [t for t in toxic if t], [t for t in ordinary if t]
    if min(len(toxic), len(ordinary)) < 2:
        return (len(toxic) + 1) / (len(toxic) + len(ordinary) + 2)
    train = lambda texts: [t for k, t in enumerate(texts) if k % 3]
    data, bounds = _joined(train(ordinary))
    windows, _ = window_bounds(bounds)
    pick = windows[:: max(1, len(windows) // 40_000)]
    plain = _dictionary([data[s:s + n].ljust(8) for s, n in pick.tolist()], PLAIN_BYTES, 48)
    marked = _dictionary(distinctive(train(toxic), train(ordinary)), TOXIC_BYTES, 16) + plain
    coders = Coder(plain), Coder(marked)
    gains = []
    for texts in (toxic[::3], ordinary[::3]):
        data, bounds = _joined(texts)
        windows, count = window_bounds(bounds)
        gains.append((coders[0].lengths(data, windows) - coders[1].lengths(data, windows), count))
    tau = float(np.quantile(gains[1][0], 0.999))
    x = np.vstack([features(gain, count, tau) for gain, count in gains])
    y = np.repeat([1.0, 0.0], [len(count) for _, count in gains])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights, bias = _logistic((x - centre) / scale, y)
    return Model(marked, plain, tau, centre, scale, weights, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, text: str = "text",
                 key: str = "doc_id") -> Model | float:
    """Fit on at most ``sample`` labelled texts of each label, those whose id hashes lowest, and ``SAMPLE_BYTES`` of each.

    ``labels`` must hold only the rows to learn from. The calibrated share of toxic texts is that of the labels.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    total = {r["__y"]: r["n"] for r in marked.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    for value in texts:
        chosen = marked.filter(F.col("__y") == value).orderBy(F.xxhash64(key), key).limit(sample)
        rows = docs.select(key, text).join(chosen, key).select(key, text).orderBy(F.xxhash64(key), text).limit(sample)
        held = 0
        for row in rows.toLocalIterator():
            data = (row[1] or "").encode().lower()
            held += len(data)
            if held > SAMPLE_BYTES and texts[value]:
                break
            texts[value].append(data)
    model = fit(texts[1], texts[0])
    if isinstance(model, Model):
        seen = np.log(max(1, len(texts[1])) / max(1, len(texts[0])))
        true = np.log(max(1, total.get(1, 0)) / max(1, total.get(0, 0)))
        model = Model(model.toxic, model.ordinary, model.tau, model.centre, model.scale, model.weights,
                      model.bias + float(true - seen))
    return model


def toxicity(docs: DataFrame, model: Model | float, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score, largest_gain, windows`` for every row; windows cover each whole text, null and empty have none.

    Rows with null or repeated ids are scored like any other. One narrow stage.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = None if isinstance(model, float) else (Coder(model.ordinary), Coder(model.toxic))
        for batch in batches:
            for start, end, data, bounds in text_chunks(batch.column(1)):
                windows, count = window_bounds(bounds)
                if coders is None:
                    score, top = np.full(end - start, model), np.zeros(end - start)
                else:
                    body = lowered(data)
                    gain = coders[0].lengths(body, windows) - coders[1].lengths(body, windows)
                    x = features(gain, count, model.tau)
                    score, top = model.score(x), x[:, 0]
                yield pa.record_batch([batch.column(0).slice(start, end - start), pa.array(score),
                                       pa.array(top), pa.array(count.astype(np.int64))],
                                      ["doc_id", "score", "largest_gain", "windows"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, score double, largest_gain double, windows long")
