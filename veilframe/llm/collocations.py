"""Phrases whose words stand together more often than their parts explain, counted by Rabin-Karp fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import mix, signed, staged, text_chunks

LONGEST = 5
#: Bits of the tables that tell tasks which fingerprints may be frequent: 16 MB, whatever the input.
TABLE_BITS = 1 << 27
#: Bytes of text that a task reads together (a longer text is a block of its own), and fingerprints that it counts together.
BLOCK_BYTES, BLOCK_PRINTS = 1 << 20, 1 << 21

_RANDOM = np.random.default_rng(977)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)[_LOWER]  # A-Z hash as a-z
_BASES = [int(b) * 2 + 1 for b in _RANDOM.integers(0, 2**63, 2)]
_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prefix_hashes(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial of ``values`` in ``base`` modulo 2**64, and the inverse powers that shift a run to the start."""
    n = len(values) + 1
    if base not in _powers or len(_powers[base][0]) < n:
        made = []
        for b in (base, pow(base, -1, 2**64)):
            powers = np.full(max(n, 1 << 20), b, np.uint64)
            powers[0] = 1
            made.append(np.cumprod(powers))
        _powers[base] = (made[0], made[1])
    powers, inverse = _powers[base]
    total = np.zeros(n, np.uint64)
    np.cumsum(values * powers[:n - 1], out=total[1:])
    return total, inverse[:n]


class Words:
    """The words of some rows: bounds in bytes, row, piece, and hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.raw, kind = data, _KIND[data]
        word = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(bounds, self.starts, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == _BREAK), self.starts) + self.row
        total, inverse = prefix_hashes(_BYTE[data], _BASES[0])
        self.hashes = mix((total[self.ends] - total[self.starts]) * inverse[self.starts]
                          + (self.ends - self.starts).astype(np.uint64))

    @cached_property
    def data(self) -> np.ndarray:
        return _LOWER[self.raw]

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k]:self.ends[k]].tobytes()

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` are spelt alike, compared byte by byte."""
        size = self.ends[a] - self.starts[a]
        alike = size == self.ends[b] - self.starts[b]
        at, size = np.flatnonzero(alike), size[alike]
        if len(at):
            first = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(first, size)
            odd = self.data[np.repeat(self.starts[a[at]], size) + step] != self.data[np.repeat(self.starts[b[at]], size) + step]
            alike[at] = ~np.logical_or.reduceat(odd, first)
        return alike


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.md5(lang.encode()).digest()[:8], "little")


def grouped(fingerprints: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """First member and size of each group of equal fingerprints whose members are the ``same`` as the first.

    Members that only share the fingerprint get another key and are grouped again, until all groups are pure.
    """
    keys = fingerprints
    while True:
        _, first, group, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        rest = np.flatnonzero(first[group] != np.arange(len(keys)))
        odd = rest[~same(rest, first[group[rest]])]
        if not len(odd):
            return first, count
        keys = keys.copy()
        keys[odd] = mix(keys[odd] + np.uint64(_BASES[1]))


_GRAM = "fingerprint long, witness long, n long, row_key long, at int, bytes int"
#: Bits of a fingerprint that the search for frequent ones counts; where two share them, more phrases are counted as spelt.
COARSE = np.uint64((1 << 40) - 1)


def witness(lang: str, words: list[bytes]) -> int:
    """60 bits of a digest of a phrase as spelt, and its language."""
    return int(hashlib.md5(b" ".join([lang.encode() + b"\0" + b"".join(words[:1]), *words[1:]])).hexdigest()[:15], 16)


WITNESS = "cast(conv(left(md5(concat(lang, char(0), phrase)), 15), 16, 10) as bigint)"


def _marked(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint is set."""
    slot = prints & np.uint64(TABLE_BITS - 1)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Block:
    """The words of a block of rows and the fingerprints of their phrases."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lang: np.ndarray, mask: np.uint64):
        self.words, self.bounds, self.mask = Words(data, bounds), bounds, mask
        self.total, self.inverse = prefix_hashes(self.words.hashes, _BASES[1])
        self.lang = lang[self.words.row]

    def prints(self, at: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the phrases of ``size`` words from words ``at``, other ones in other languages."""
        run = (self.total[at + size] - self.total[at]) * self.inverse[at]
        return mix(run + self.lang[at] + np.uint64(size)) & self.mask

    def phrases(self, size: int, table: np.ndarray | None) -> np.ndarray:
        """Where phrases of ``size`` words start whose shorter parts are all marked."""
        words = self.words
        at = np.arange(max(0, len(words.starts) - size + 1))
        at = at[words.piece[at] == words.piece[at + size - 1]]
        if table is not None and size > 1:
            at = at[_marked(table, self.prints(at, size - 1))]
            at = at[_marked(table, self.prints(at + 1, size - 1))]
        return at


def _blocks(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[int, Block, np.ndarray, list[str]]]:
    """First row, block, language of each row as a number, languages."""
    codes = batch.column(1).dictionary_encode()
    names, number = codes.dictionary.to_pylist(), codes.indices.to_numpy()
    lang = np.array([_lang_hash(x) for x in names], np.uint64)[number] if names else np.zeros(0, np.uint64)
    for start, end, data, bounds in text_chunks(batch.column(2), BLOCK_BYTES):
        block = Block(data, bounds, lang[start:end], np.uint64(2**bits - 1))
        if len(block.words.starts):
            yield start, block, number[start:end], names


def _prints(docs: DataFrame, size: int, frequent, bits: int) -> DataFrame:
    """``fingerprint, n`` of the phrases of ``size`` words whose parts may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            prints, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(signed(prints)), pa.array(n)], ["fingerprint", "n"])

        for batch in batches:
            for _, block, _, _ in _blocks(batch, bits):
                held.append(block.prints(block.phrases(size, frequent and frequent.value), size) & COARSE)
                if sum(map(len, held)) >= BLOCK_PRINTS:
                    yield counted()
        if held:
            yield counted()

    return docs.select("row_key", "lang", "text").mapInArrow(run, "fingerprint long, n long")


def _grams(docs: DataFrame, longest: int, frequent, bits: int) -> DataFrame:
    """Counts of all phrases with a marked fingerprint, a block of text at a time, each with one occurrence of it.

    ``witness`` tells phrases of one fingerprint apart between tasks; within a block they are told apart
    byte by byte. The empty phrase stands for the words of a language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for start, block, number, names in _blocks(batch, bits):
                words, parts = block.words, []
                for size in range(1, longest + 1):
                    at = block.phrases(size, frequent.value)
                    found = block.prints(at, size)
                    keep = _marked(frequent.value, found)
                    at, found = at[keep], found[keep]

                    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                        alike = block.lang[at[a]] == block.lang[at[b]]
                        for k in range(size):
                            alike &= words.same(at[a] + k, at[b] + k)
                        return alike

                    first, count = grouped(found, same)
                    head = at[first]
                    row = words.row[head]
                    spelt = [witness(names[c], [words.text(k + j) for j in range(size)]) for c, k in zip(number[row].tolist(), head.tolist())]
                    begin = words.starts[head] - block.bounds[row]
                    parts.append((signed(found[first]), np.array(spelt, np.int64), count, keys[start + row], begin,
                                  words.ends[head + size - 1] - block.bounds[row] - begin))
                seen, first, n = np.unique(number[words.row], return_index=True, return_counts=True)
                none = np.zeros(len(seen), np.int64)
                parts.append((none, np.array([witness(names[c], []) for c in seen.tolist()], np.int64), n, keys[start + words.row[first]], none, none))
                columns = [np.concatenate(c) for c in zip(*parts)]
                yield pa.record_batch([pa.array(c.astype(np.int32) if k > 3 else c) for k, c in enumerate(columns)],
                                      [c.split()[0] for c in _GRAM.split(", ")])

    return docs.select("row_key", "lang", "text").mapInArrow(run, _GRAM)


def _bit_table(df: DataFrame, column: str) -> np.ndarray:
    """Bit table of the longs in a column: at most ``TABLE_BITS`` bits reach the driver."""
    slot = F.expr(f"pmod({column}, {TABLE_BITS}L) + 1")
    pages = df.select(F.bitmap_bucket_number(slot).alias("page"), F.bitmap_bit_position(slot).alias("bit")).groupBy("page").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()
    table = np.zeros(TABLE_BITS // 8, np.uint8)
    for r in pages:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        table[(r["page"] - 1) * len(part):r["page"] * len(part)] = part
    return table


def _spelt(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang, size, phrase, f``: each phrase cut out of the text that its occurrence points to, and held against its witness."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(_bit_table(grams, "row_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            yield batch.filter(pa.array(_marked(bits, batch.column(0).to_numpy().view(np.uint64))))

    texts = docs.select("row_key", "lang", "text").mapInArrow(run, "row_key long, lang string, text string").dropDuplicates()
    cut = "decode(substring(cast(text as binary), at + 1, bytes), 'UTF-8')"
    return grams.join(texts, "row_key").select(
        "lang", F.expr(f"regexp_replace({lowered(cut)}, '[ \\t]+', ' ')").alias("phrase"), F.col("n").alias("f"), "witness").filter(
        f"witness = {WITNESS}").groupBy("lang", "phrase").agg(F.max("f").alias("f")).withColumn(
        "size", F.expr("if(phrase = '', 0, size(split(phrase, ' ')))"))


def lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, text: str = "text", lang: str = "lang",
                     bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``least`` occurrences in a language, and the words of each language.

    First ``lang, size, phrase, f``, then ``lang, n`` of languages with that many words. A text is split
    into pieces at ``.,;:!?`` and line ends and these into words at blanks; A-Z counts as a-z; a null text
    is empty, a null language is ``und``; repeated rows count as often as they occur. No rows give no rows.

    Sizes are counted one after the other, as fingerprints only. The frequent ones are marked in a bit
    table of bounded size, which lets tasks leave out phrases with a rare part. Where the table fills up,
    more rare phrases are counted, and the result stays the same. The marked phrases are then counted as
    spelt, together with a pointer to one occurrence, and only frequent ones are cut out of the texts.
    ``bits`` is the length of the fingerprints; with few, more phrases share one and the texts decide.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(text, lang).alias("row_key"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                       F.col(text).alias("text"))
    table, frequent, reached = np.zeros(TABLE_BITS // 8, np.uint8), None, 1
    for size in range(1, longest + 1):
        counted = _prints(rows, size, frequent, bits).groupBy("fingerprint").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = _bit_table(counted, "fingerprint")
        table = table | found
        frequent, reached = spark.sparkContext.broadcast(table), size
        if not found.any():
            break
    grams = staged(_grams(rows, reached, frequent, bits).groupBy("fingerprint", "witness").agg(
        F.sum("n").alias("n"), *(F.any_value(c).alias(c) for c in ("row_key", "at", "bytes"))).filter(F.col("n") >= least), "grams")
    phrases = staged(_spelt(rows, grams), "phrases")
    return phrases.filter("size > 0"), phrases.filter("size = 0").select("lang", F.col("f").alias("n"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = LONGEST, cover: int = 100,
                 text: str = "text", lang: str = "lang", bits: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score.

    A phrase of 2 to ``longest`` words with ``a`` occurrences, at least ``least``, is cut after each of
    its words; ``l`` and ``r`` count the parts, ``n`` all words of the language, and the score is
    floor(1000 a n / (l r)) of the lowest cut, the earliest of equal ones. Phrases within a longer one
    that has ``cover`` per cent of their occurrences are left out: it is enough to look at phrases of one
    word more, since any between the two occurs at least as often as the longest. Equal scores rank by
    ``a``, then by the phrase's bytes. Texts, languages, repeated rows and empty tables count as in
    ``frequent_phrases``.
    """
    phrases, words = frequent_phrases(docs, least, longest, text, lang, bits)
    many = phrases.filter("size > 1").withColumn("w", F.split("phrase", " "))
    part = "array_join(slice(w, {}, {}), ' ')"
    longer = many.filter("size > 2").select("lang", "f", F.explode(F.array(
        F.expr(part.format(1, "size - 1")), F.expr(part.format(2, "size - 1")))).alias("phrase")).groupBy("lang", "phrase").agg(
        F.max("f").alias("within"))
    open_ = many.join(longer, ["lang", "phrase"], "left").filter(f"within is null or 100 * within < {cover} * f")
    cuts = open_.select("lang", "phrase", "w", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr(part.format(1, "k")).alias("left"), F.expr(part.format("k + 1", "size - k")).alias("right"))
    parts = phrases.select("lang", "phrase", "f")
    scored = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(
        parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).join(words, "lang").withColumn(
        "score", F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select(
        "lang", "phrase", "a", "n", "low.l", "low.r", "low.score")
    rank = "row_number() over (partition by lang{} order by score desc, a desc, phrase)"
    # the best of every share first, so that no task ranks a whole language
    return lowest.withColumn("share", F.expr("pmod(xxhash64(phrase), 64)")).withColumn("place", F.expr(rank.format(", share"))).filter(
        F.col("place") <= top).withColumn("rank", F.expr(rank.format("")).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
