"""Document log-likelihood by a gated recurrent language model with class-factored output, in numpy.

The recurrence reads frequent words and, for all others, the class of their shape. Its output is a softmax over
classes, then over the words of a class; within a shape class, words follow their add-one share of
the counts of all training documents. So every string has a probability and they sum to at most one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import staged

#: Words with a softmax entry of their own, frequency classes they fall into, and width of the state.
OWN, CLASSES, STATE = 500, 20, 16
#: Most frequent words whose counts every task holds; the counts of all others are joined.
HELD = 200_000
SHAPES = 16
#: One in so many training documents fits the recurrence, 1 is all of them; passes over them; steps of a window.
EVERY, ROUNDS, WINDOW = 1, 2, 16
LANES, FIT_LANES, RATE = 256, 192, 0.02
BATCH_BYTES = 8 << 20
#: Bytes of texts that are split into words at a time.
SPLIT_BYTES = 4 << 20


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) runs of anything but ASCII white space, text after text, and where each text begins and ends."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    words, bounds = found.flatten(), found.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    some = pc.greater(pc.binary_length(words), 0)  # white space around a text leaves empty words
    if not pc.all(some, min_count=0).as_py():
        bounds = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[bounds]
        words = words.filter(some)
    return words, bounds


def shapes(words: pa.Array) -> np.ndarray:
    """The classes of words without an entry of their own: length, other alphabets, closing punctuation."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    last = pc.binary_slice(words.cast(pa.binary()), -1)
    ended = pc.is_in(last, value_set=pa.array([bytes([c]) for c in b".,!?;:"])).to_numpy(zero_copy_only=False)
    return np.minimum(size // 3, 3) * 4 + ~plain * 2 + ended


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, shape, c`` over all of ``docs``; each task adds up before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []

        def added() -> pa.Table:
            return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            for part in added().combine_chunks().to_batches() if parts else ():
                yield pa.record_batch([part.column("word"), pa.array(shapes(part.column("word")).astype(np.int32)), part.column("n")],
                                      ["word", "shape", "n"])
            parts.clear()

        for batch in _parts(batches, 0, SPLIT_BYTES):
            found = words_of(batch.column(0))[0].value_counts()
            parts.append(pa.table([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"]))
            if sum(map(len, parts)) > 600_000:
                parts[:] = [added()]
                if len(parts[0]) > 300_000:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, shape int, n long").groupBy(
        "word", "shape").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Counts that all tasks hold. The end of a text is the entry ``own``, after the words of their own."""

    words: pa.Array  # those held, by count
    counts: np.ndarray  # of the held words
    own: int
    shapes: np.ndarray  # of the held words
    end: int  # training documents
    tokens: int
    distinct: int
    shape_tokens: np.ndarray
    shape_words: np.ndarray

    @property
    def unit(self) -> int:
        return self.tokens + self.distinct + 1

    def groups(self) -> list[np.ndarray]:
        """Entries of each frequency class, the end among them."""
        order = np.argsort(-np.append(self.counts[:self.own], self.end), kind="stable")
        return np.array_split(order, min(CLASSES, len(order)))


@dataclass
class Texts:
    """Entries of texts one after the other, and where each begins and ends."""

    entries: np.ndarray
    bounds: np.ndarray


class Network:
    """A gated recurrent unit over entries (own words, the end, shapes) with a two-step softmax."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 17):
        self.own, self.groups = vocabulary.own, vocabulary.groups()
        entries, classes = self.own + 1 + SHAPES, len(self.groups) + SHAPES
        self.class_of = np.zeros(entries, np.int64)
        self.place = np.zeros(entries, np.int64)
        for k, group in enumerate(self.groups):
            self.class_of[group], self.place[group] = k, np.arange(len(group))
        self.class_of[self.own + 1:] = len(self.groups) + np.arange(SHAPES)
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        mass = np.concatenate((vocabulary.counts[:self.own], [vocabulary.end], vocabulary.shape_tokens)).astype(float) + 1
        by_class = np.bincount(self.class_of, mass, classes)
        self.p = {"E": draw(entries, 3 * STATE), "U": draw(STATE, 3 * STATE), "C": draw(STATE, classes),
                  "c": np.log(by_class / by_class.sum()).astype(np.float32), "W": draw(entries, STATE),
                  "w": np.log(mass / by_class[self.class_of]).astype(np.float32)}
        self.p["E"][:, :STATE] += 1.0
        self.members = np.zeros((len(self.groups), max(map(len, self.groups))), np.int64)
        for k, group in enumerate(self.groups):
            self.members[k, :len(group)] = group
        self.at = self.class_of[:self.own + 1] * self.members.shape[1] + self.place[:self.own + 1]
        self.pad = np.ones(self.members.shape, bool)
        self.pad.reshape(-1)[self.at] = False

    def run(self, h: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, ...]:
        """States (the one before each step, then the last), gates, candidates and their recurrent part.

        ``x`` holds entries by step and lane, ``begin`` tells where a text begins; ``h`` and all results have a row
        per unit and a column per lane, so each operation is one run over adjoining numbers.
        """
        steps, lanes = x.shape
        signs = np.repeat(np.float32([-1, 1]), [2 * STATE, STATE])
        a = np.ascontiguousarray(np.take(self.p["E"] * signs, x, axis=0).transpose(0, 2, 1))
        gates, n = a[:, :2 * STATE], a[:, 2 * STATE:]
        weights = np.ascontiguousarray((self.p["U"] * signs).T)
        states, u = np.empty((steps + 1, STATE, lanes), np.float32), np.empty((steps, 3 * STATE, lanes), np.float32)
        un = u[:, 2 * STATE:]
        states[0] = h
        some, goes, one, part = begin.any(axis=1).tolist(), ~begin, np.float32(1), np.empty((STATE, lanes), np.float32)
        for t, (before, after, g, z, r, c, ut, ug, uc) in enumerate(zip(
                states, states[1:], gates, a[:, :STATE], gates[:, STATE:], n, u, u[:, :2 * STATE], un)):
            if some[t]:
                before *= goes[t]
            np.matmul(weights, before, out=ut)
            g += ug
            np.exp(g, out=g)
            g += one
            np.reciprocal(g, out=g)
            c += np.multiply(r, uc, out=part)
            np.tanh(c, out=c)
            np.subtract(before, c, out=after)
            after *= z
            after += c
        return states, gates, n, un

    def by_class(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """Places of entries in order of their classes, and where each frequency class is; shapes come after these."""
        k = self.class_of[x].astype(np.int16)
        order = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[order], np.arange(len(self.groups) + 1)).tolist()
        return order, [(n, slice(i, j)) for n, (i, j) in enumerate(zip(cut, cut[1:])) if i < j]

    def log_probability(self, h: np.ndarray, x: np.ndarray, runs: list, g: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of entries ``x``, which are in order of their classes, after states ``h`` (a row each, then 1).

        With ``g``, also gradients of its negative sum.
        """
        k, own = self.class_of[x], runs[-1][1].stop if runs else 0
        seen = h.T

        def softmax(logits: np.ndarray, at: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
            """Log probabilities of rows ``at``; ``logits``, at most ``most`` from zero, become their gradients."""
            if not most < 40:  # else their powers are far from the limits of single precision
                logits -= logits.max(axis=0)
            flat, at = logits.reshape(-1), at * np.int64(len(at)) + np.arange(len(at))
            out = flat[at]
            np.exp(logits, out=logits)
            total = logits.sum(axis=0)
            if g is not None:
                logits *= 1 / total
                flat[at] -= 1
            return out - np.log(total)

        weights = np.vstack((self.p["C"], self.p["c"])).T
        d, dh = weights @ seen, None
        out = softmax(d, k, np.abs(weights).sum(axis=1).max())  # states are within -1 and 1
        if g is not None:
            dw = d @ h
            g["C"] += dw[:, :STATE].T
            g["c"] += dw[:, STATE]
            dh = d.T @ self.p["C"].T
        weights = np.hstack((self.p["W"], self.p["w"][:, None]))
        most = np.abs(weights[:self.own + 1]).sum(axis=1).max()
        weights = np.take(weights, self.members, axis=0)  # members of a class, then padding
        weights[self.pad, STATE] = -1e30
        d = np.empty((self.members.shape[1], own), np.float32)
        for n, run in runs:
            np.matmul(weights[n], seen[:, run], out=d[:, run])
        out[:own] += softmax(d, self.place[x[:own]], most)
        if g is not None:
            dw, back = np.zeros_like(weights), np.empty((own, STATE), np.float32)
            for n, run in runs:
                np.matmul(d[:, run], h[run], out=dw[n])
                np.matmul(d[:, run].T, weights[n, :, :STATE], out=back[run])
            dh[:own] += back
            dw = dw.reshape(-1, STATE + 1)[self.at]
            g["W"][:self.own + 1], g["w"][:self.own + 1] = dw[:, :STATE], dw[:, STATE]
        return out, dh

    def sums(self, rows: np.ndarray, x: np.ndarray, runs: list, out: np.ndarray) -> None:
        """Rows added up by their entries ``x``, which are in order of their classes."""
        own, (classes, size) = runs[-1][1].stop if runs else 0, self.members.shape
        parts, which = np.zeros((classes, size, rows.shape[1]), np.float32), np.zeros((size, own), np.float32)
        which.reshape(-1)[self.place[x[:own]] * own + np.arange(own)] = 1
        for n, run in runs:
            np.matmul(which[:, run], rows[run], out=parts[n])
        out[:self.own + 1] = parts.reshape(-1, rows.shape[1])[self.at]
        cut, one = np.searchsorted(x[own:], self.own + 1 + np.arange(SHAPES + 1)).tolist(), np.ones(len(x) - own, np.float32)
        for k, (i, j) in enumerate(zip(cut, cut[1:])):
            np.matmul(one[i:j], rows[own + i:own + j], out=out[self.own + 1 + k])

    @staticmethod
    def lanes(texts: Texts, lanes: int, stretch: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows of texts side by side, by step and lane: entries (-1: none left), their texts, where a text begins.

        A lane takes one whole text after the other. The longest are dealt first, each to the lane with the
        fewest entries; lanes keep the order of their texts, and the lanes of a window are the first of those before.
        With ``stretch``, a window of fewer lanes has as many more steps, so it holds no fewer entries.
        """
        sizes = np.diff(texts.bounds)
        lane, load = np.empty(len(sizes), np.int64), [(0, k) for k in range(min(lanes, len(sizes)))]
        for row in np.argsort(-sizes, kind="stable").tolist():
            held, k = load[0]
            lane[row] = k
            heapq.heapreplace(load, (held + int(sizes[row]), k))
        rank = np.empty(len(load), np.int64)
        held = np.array([n for n, _ in sorted(load, key=lambda x: (-x[0], x[1]))], np.int64)
        rank[[k for _, k in sorted(load, key=lambda x: (-x[0], x[1]))]] = np.arange(len(load))
        order = np.argsort(rank[lane], kind="stable")
        ends = np.cumsum(sizes[order])
        rows = np.repeat(order.astype(np.int32), sizes[order])
        moved = texts.entries[np.repeat(texts.bounds[order] - (ends - sizes[order]), sizes[order]) + np.arange(len(rows))]
        first = np.zeros(len(rows), bool)
        first[ends - sizes[order]] = True
        start = np.cumsum(held) - held
        at = 0
        while at < (held[0] if len(held) else 0):
            live = int(np.searchsorted(-held, -at, "left"))
            steps = min(WINDOW * lanes // live, int(held[0]) - at) if stretch else WINDOW
            step = np.arange(at, at + steps)[:, None]
            place, there = np.minimum(start[:live] + step, len(rows) - 1), step < held[:live]
            yield np.where(there, moved[place], np.int16(-1)), rows[place], first[place] & there
            at += steps

    def score(self, texts: Texts) -> np.ndarray:
        """Natural log probability of each whole text; the state is carried from window to window."""
        out, h = np.zeros(len(texts.bounds) - 1), np.zeros((STATE, LANES), np.float32)
        for x, rows, begin in self.lanes(texts, LANES, stretch=True):
            states = self.run(h[:, :x.shape[1]], np.maximum(x, 0), begin)[0]
            h = states[-1]
            at = np.flatnonzero(x >= 0)
            order, runs = self.by_class(x.ravel()[at])
            at = at[order]
            logs, _ = self.log_probability(np.take(_by_row(states[:-1], 1), at, axis=0), x.ravel()[at], runs)
            out += np.bincount(rows.ravel()[at], logs, len(out))
        return out

    def gradients(self, h: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Gradients of all parameters in a window, one after the other, the states after it, and its tokens."""
        steps, lanes = x.shape
        read = np.maximum(x, 0)
        states, gates, n, un = self.run(h, read, begin)
        before, z, r = states[:-1], gates[:, :STATE], gates[:, STATE:]
        values = np.zeros(sum(v.size for v in self.p.values()), np.float32)
        g = _views(values, self.p)
        at = np.flatnonzero(x >= 0)
        order, runs = self.by_class(x.ravel()[at])
        at = at[order]
        seen = _by_row(before, 1)
        there = np.zeros(x.size, np.int64)
        there[at] = np.arange(len(at))
        dseen = np.take(self.log_probability(np.take(seen, at, axis=0), x.ravel()[at], runs, g)[1], there, axis=0)
        if len(at) < x.size:
            dseen[x.ravel() < 0] = 0
        dseen = np.ascontiguousarray(dseen.reshape(steps, lanes, STATE).transpose(0, 2, 1))
        # What a step's gradient is multiplied with, for the recurrent part of the candidate, both gates and the candidate.
        du = np.empty((steps, 4, STATE, lanes), np.float32)
        dn = np.multiply(n, n, out=du[:, 3])
        np.subtract(1, dn, out=dn)
        open_ = 1 - z
        dn *= open_
        open_ *= z
        np.subtract(before, n, out=du[:, 1])
        du[:, 1] *= open_
        np.multiply(dn, r, out=du[:, 0])
        np.multiply(du[:, 0], un, out=du[:, 2])
        du[:, 2] *= np.subtract(1, r, out=open_)
        dh, turn = np.zeros((STATE, lanes), np.float32), [*range(2 * STATE, 3 * STATE), *range(2 * STATE)]
        back, some, goes = np.ascontiguousarray(self.p["U"][:, turn]), begin.any(axis=1).tolist(), ~begin
        inner, part = du[:, :3].reshape(steps, 3 * STATE, lanes), np.empty((STATE, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            du[t] *= dh
            dh *= z[t]
            dh += dseen[t]
            dh += np.matmul(back, inner[t], out=part)
            if some[t]:
                dh *= goes[t]
        rows = _by_row(du.reshape(steps, 4 * STATE, lanes))
        g["U"][:, turn] = seen[:, :STATE].T @ rows[:, :3 * STATE]
        self.sums(np.take(rows, at, axis=0)[:, STATE:], x.ravel()[at], runs, g["E"])
        return values, states[-1], len(at)

    def train(self, texts: Texts, moments: np.ndarray) -> int:
        """Truncated backpropagation: gradients end at the window, the state goes on. Returns tokens seen.

        ``moments`` holds the running squares of all parameters' gradients, one after the other, and is kept up.
        """
        values = np.concatenate([v.ravel() for v in self.p.values()])
        self.p, square = _views(values, self.p), np.empty_like(values)
        tokens, h = 0, np.zeros((STATE, FIT_LANES), np.float32)
        for x, _, begin in self.lanes(texts, FIT_LANES):
            g, h, count = self.gradients(h[:, :x.shape[1]], x, begin)
            tokens += count
            g *= np.float32(max(1, count) ** -0.5)
            np.clip(g, -1, 1, out=g)
            moments += np.multiply(g, g, out=square)
            g /= np.sqrt(moments, out=square)
            g *= np.float32(RATE)
            values -= g
        return tokens


def _views(values: np.ndarray, like: dict) -> dict:
    """``values`` cut into arrays of the shapes in ``like``."""
    ends = np.cumsum([v.size for v in like.values()]).tolist()
    return {k: values[end - v.size:end].reshape(v.shape) for (k, v), end in zip(like.items(), ends)}


def _by_row(units: np.ndarray, ones: int = 0) -> np.ndarray:
    """Steps of units by lane as a row for each step and lane, with ``ones`` columns of 1 behind."""
    steps, size, lanes = units.shape
    out = np.empty((steps, lanes, size + ones), np.float32)
    out[:, :, :size] = units.transpose(0, 2, 1)
    out[:, :, size:] = 1
    return out.reshape(-1, size + ones)


def _parts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes in ``column``; a longer value is a batch of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, part, row = shared.value, TaskContext.get().partitionId(), 0
        own = vocabulary.own
        log_c = np.log10(vocabulary.counts + 1.0)
        held_n = np.log10(vocabulary.shape_tokens + vocabulary.shape_words + 1.0)
        tail_c = log_c - held_n[vocabulary.shapes]
        tail_c[:own] = 0.0
        entry = np.where(np.arange(len(log_c)) < own, np.arange(len(log_c)), own + 1 + vocabulary.shapes).astype(np.int16)
        unit, end = np.log10(float(vocabulary.unit)), np.log10(vocabulary.end + 1.0)
        for batch in _parts(batches, 1, SPLIT_BYTES):
            n = len(batch)
            words, bounds = words_of(batch.column(1))
            sizes = np.diff(bounds)
            coded = words.dictionary_encode()  # each word of a part is looked up once
            words, which = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
            ids = pc.fill_null(pc.index_in(words, value_set=vocabulary.words), -1).to_numpy()
            held = ids >= 0
            entries, base, tail = np.empty(len(ids), np.int16), np.zeros(len(ids)), np.zeros(len(ids))
            entries[held], base[held], tail[held] = entry[ids[held]], log_c[ids[held]], tail_c[ids[held]]
            entries[~held] = own + 1 + shapes(words.filter(pa.array(~held)))
            of, there = np.repeat(np.arange(n), sizes), held[which]
            x = np.insert(entries[which], bounds[1:], own)  # the end of each text
            known = np.bincount(of[there], minlength=n)
            pairs, many = np.unique(of[~there] * max(1, len(ids)) + which[~there], return_counts=True)  # words that are not held
            rest, cut = words.take(pa.array(pairs % max(1, len(ids)))), np.searchsorted(pairs, np.arange(n + 1) * max(1, len(ids)))
            cut, offsets = pa.array(cut.astype(np.int32)), ((bounds + np.arange(n + 1)) * 2).astype(np.int32)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)),
                 pa.array(sizes + 1), pa.array(known + (vocabulary.end > 0)),
                 pa.array(np.bincount(of, base[which], n) - unit * (known + 1) + end),
                 pa.array(np.bincount(of, tail[which], n), pa.float64()),  # whole numbers where a part has no words
                 pa.ListArray.from_arrays(cut, rest), pa.ListArray.from_arrays(cut, pa.array(many, pa.int64())),
                 pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(x)])],
                ["doc_id", "fits", "part", "row", "n_tokens", "n_known", "base_score", "score", "rest", "many", "x"])
            row += n

    return run


def encoded(docs: DataFrame, shared, fits: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The texts of ``docs`` as entries of the network, staged once for all passes over them.

    Beside them: sums over held words, the words that are not held, and whether a row ``fits`` the recurrence.
    """
    return staged(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), fits.alias("fits")).mapInArrow(
        _encode(shared), "doc_id long, fits boolean, part int, row long, n_tokens long, n_known long, base_score double, "
        "score double, rest array<string>, many array<long>, x binary"), "entries")


def _texts(column: pa.Array) -> Texts:
    """The entries of an Arrow column, not copied."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // 2
    return Texts(np.frombuffer(column.buffers()[2], np.int16, int(bounds[-1])), bounds.astype(np.int64))


def _fit(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, moments = 0, np.full(sum(v.size for v in network.p.values()), 1e-3, np.float32)
        for batch in _parts(batches, 0, BATCH_BYTES):
            tokens += network.train(_texts(batch.column(0)), moments)
        if tokens:
            part = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(list(network.p)), pa.array([part] * len(network.p), pa.int32()),
                                   pa.array([v.astype(np.float32).tobytes() for v in network.p.values()], pa.binary()),
                                   pa.array([tokens] * len(network.p), pa.int64())], ["name", "part", "value", "tokens"])

    return run


def _mean(group: pa.Table) -> pa.Table:
    """The mean of parameter vectors, weighted by the tokens behind them."""
    tokens = group.column("tokens").to_numpy()
    total = sum(np.frombuffer(v.as_py(), np.float32).astype(np.float64) * n for v, n in zip(group.column("value"), tokens))
    return pa.table({"name": group.column("name")[:1], "part": pa.array([0], pa.int32()),
                     "value": pa.array([(total / tokens.sum()).astype(np.float32).tobytes()], pa.binary()),
                     "tokens": pa.array([int(tokens.sum())], pa.int64())})


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: DataFrame
    parameters: dict


def learnt_counts(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, DataFrame]:
    """What all tasks hold of the words of ``docs``, and the counts of all words."""
    counts = staged(word_counts(docs, text), "words")
    held = counts.orderBy(F.desc("c"), "word").limit(HELD).select("word", "shape", "c").toArrow()
    words = pa.concat_arrays(held.column("word").chunks or [pa.array([], pa.string())]).cast(pa.string())
    sums = {r["shape"]: r for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_docs = docs.count()
    c, s = held.column("c").to_numpy().astype(np.int64), held.column("shape").to_numpy().astype(np.int64)
    own = min(OWN, len(words))
    tail_n = np.array([sums[k]["n"] if k in sums else 0 for k in range(SHAPES)]) - np.bincount(s[:own], c[:own], SHAPES).astype(np.int64)
    tail_v = np.array([sums[k]["v"] if k in sums else 0 for k in range(SHAPES)]) - np.bincount(s[:own], minlength=SHAPES)
    return Vocabulary(words, c, own, s, n_docs, int(sum(r["n"] for r in sums.values())) + n_docs,
                      int(sum(r["v"] for r in sums.values())) + (n_docs > 0), tail_n, tail_v), counts


def fit_recurrence(rows: DataFrame, vocabulary: Vocabulary) -> dict:
    """Parameters of the network after all rounds over the ``encoded`` rows.

    The recurrence is trained where the rows are: each task runs over its own share of all of
    them, and the tasks' parameters are averaged after each round, in two steps.
    What is gathered grows with the input; the driver sees the averages.
    """
    schema, network = "name string, part int, value binary, tokens long", Network(vocabulary)
    for _ in range(ROUNDS):
        tasks = rows.select("x").mapInArrow(_fit(network), schema).withColumn("bucket", F.col("part") % 32)
        near = tasks.groupBy("name", "bucket").applyInArrow(_mean, schema)
        for r in near.groupBy("name").applyInArrow(_mean, schema).collect():
            network.p[r["name"]] = np.frombuffer(bytes(r["value"]), np.float32).reshape(network.p[r["name"]].shape).copy()
    return network.p


def _taken(key: str) -> Column:
    """Whether a training document fits the recurrence."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(EVERY)) == 0


def fit_language_model(docs: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Counts over all of ``docs``, which must hold the training documents only, then the recurrence."""
    vocabulary, counts = learnt_counts(docs, text)
    rows = encoded(docs.filter(_taken(key)), docs.sparkSession.sparkContext.broadcast(vocabulary), F.lit(True), text, key)
    return Model(vocabulary, counts, fit_recurrence(rows, vocabulary))


def score_documents(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Null text is empty: just its end. Rows with null or repeated ids are scored like any other. Words
    outside the held ones meet their counts in a join; none of these is frequent, so no key is hot.
    """
    rows = encoded(docs, docs.sparkSession.sparkContext.broadcast(model.vocabulary), F.lit(False), text, key)
    return _scored(rows, model)


def fit_and_score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The scores of all ``docs`` by a model of those where ``train`` holds; each text is encoded once for both."""
    vocabulary, counts = learnt_counts(docs.filter(train), text)
    rows = encoded(docs, docs.sparkSession.sparkContext.broadcast(vocabulary), train & _taken(key), text, key)
    return _scored(rows, Model(vocabulary, counts, fit_recurrence(rows.filter("fits"), vocabulary)))


def _score(network: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 7, BATCH_BYTES):
            score = network.score(_texts(batch.column(7))) / np.log(10) + batch.column(6).to_numpy()
            yield pa.record_batch([*batch.columns[:6], pa.array(score)], batch.schema.names[:7])

    return run


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    v = model.vocabulary
    network = Network(v)
    network.p = model.parameters
    scores = staged(rows.select("doc_id", "part", "row", "n_tokens", "n_known", "base_score", "score", "x").mapInArrow(
        _score(network), "doc_id long, part int, row long, n_tokens long, n_known long, base_score double, score double"), "scores")
    rest = rows.select("part", "row", F.explode(F.arrays_zip("rest", "many")).alias("x")).select(
        "part", "row", F.col("x.rest").alias("word"), F.col("x.many").alias("n"))
    shapes = F.expr("array(" + ",".join(repr(float(np.log10(n + d + 1.0))) + "D" for n, d in zip(v.shape_tokens, v.shape_words)) + ")")
    word_shape = (F.least(F.floor(F.octet_length("word") / 3), F.lit(3)) * 4
                  + F.when(F.octet_length("word") != F.char_length("word"), 2).otherwise(0)
                  + F.when(F.expr("rlike(word, r'[.,!?;:]$')"), 1).otherwise(0)).cast("int")
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    sums = (rest.join(model.counts.select("word", "c"), "word", "left").groupBy("part", "row").agg(
        F.sum(F.col("n") * (log_c - float(np.log10(float(v.unit))))).alias("base"),
        F.sum(F.col("n") * (log_c - F.element_at(shapes, word_shape + 1))).alias("tail"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")))
    return scores.join(sums, ["part", "row"], "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail", F.lit(0.0))).alias("score"))
