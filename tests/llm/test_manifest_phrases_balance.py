"""Dataset manifest, phrase collocations and cost-balanced packing against brute force on small tables."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import balance, collocations, manifest
from veilframe.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("g", "at", "many", "digest", "payload", "spot", "part", "row_key", "size", "n", "f", "w", "start", "length")


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASH})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Root of the nodes and, for each, its siblings to the left and right level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for x, i in enumerate(own):
            run = i // 3 * 3
            paths[x].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
            own[x] = i // 3
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(row, text):
        doc, _, lang, source, n = row
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    sources = collections.defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0], leaf(r, r[1]))):
        sources[row[3]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf(r, r[1]) for r in sources[s]]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    for s, up in zip(names, above):
        for row, path in zip(sources[s], trees[s][1]):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(row, text)
            for left, right in path + up:
                node = sha(left + node + right)
            yield (row[0], leaf(row, row[1]), trees[s][0], root, sha("".join(a + b for a, b in path + up)), node, node == root)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)  # many climbs, or one
    rows = [(k, f"line {k}\nnext\n", "en", "hot" if k % 3 else f"s{k % 5}", k) for k in range(100)]
    rows += [(None, "no id\n", None, None, None), (7, "twice", "en", "hot", 1), (7, "twice", "en", "hot", 1), (7, "other\n", "en", "hot", 1),
             (200, None, "de", "é", 0), (201, "", "de", "", 0), (-4, "\n" * 2000 + "x" * 50_000, "fr", "lone", 9)]
    got = collections.Counter(tuple(r) for r in manifest.manifest(frame(spark, rows)).collect())
    assert got == collections.Counter(plain_manifest(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_one_and_of_none(spark):
    row = (3, "only", "en", "s", 4)
    assert [tuple(r) for r in manifest.manifest(frame(spark, [row])).collect()] == list(plain_manifest([row]))
    assert manifest.manifest(frame(spark, [])).collect() == []


def plain_phrases(rows, least, top, cover=100):
    counts, words = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _, _ in rows:
        lang = lang or ("und" if lang is None else lang)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, found in counts.items():
        found = {p: c for p, c in found.items() if c >= least}
        inside = collections.Counter()
        for p, c in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], c)
        ranked = []
        for p, a in found.items():
            if len(p) > 1 and 100 * inside[p] < cover * a:
                score, k = min((1000 * a * words[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            yield (lang, rank, p.decode(), -a, left, right, words[lang], -s)


def phrase_rows():
    r = random.Random(4)
    fixed = ["new york city", "Rio de Janeiro", "a a a a a a", "größer als\tje zuvor", "to be or not to be"]
    rows = []
    for k in range(150):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice("the of river stone light new york be x".split()) for _ in range(30)]
        rows.append((k % 40, "".join(p + r.choice(["  ", " ", " ", ". ", "\n", "\t", ";"]) for p in parts),
                     r.choice(["en", "en", "de", None, ""]), "s", 1))
    return rows + [(None, None, "en", None, None), (5, "", None, None, None), (6, " \n. ", "xx", "s", 1), (9, "the of " * 20_000, "long", "s", 1)]


@pytest.mark.parametrize("bits", [64, 6])  # with 6 bits most phrases share a fingerprint with others
@pytest.mark.parametrize(("top", "cover"), [(2000, 100), (7, 60)])
def test_collocations(spark, bits, top, cover, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 5_000)
    rows = phrase_rows()
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), 12, top, cover=cover, bits=bits).collect())
    want = sorted(plain_phrases(rows, 12, top, cover))
    assert got == want and {r[0] for r in got} >= {"en", "de", "und", "", "long"}


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, "rare words only", "en", "s", 1)])).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    made = spark.range(1).selectExpr("(cast(1000 * 900000000000 as decimal(19, 0)) * cast(70000000000000 as decimal(19, 0))) div "
                                     "(cast(900000000001 as decimal(19, 0)) * cast(950000000007 as decimal(19, 0))) as s")
    assert made.first().s == 1000 * 900000000000 * 70000000000000 // (900000000001 * 950000000007)


def plain_balance(lengths, size):
    """Every step looks at every sequence."""
    rooms = balance.capacities(sum(lengths), size)
    cost, full = [0.0] * len(rooms), list(rooms)
    waiting = sorted((-min(size, n - at), k, at) for k, n in enumerate(lengths) for at in range(0, n, size))
    placed = []
    while waiting:
        length, k, start = waiting.pop(0)
        fits = [(cost[i], i) for i, room in enumerate(rooms) if room >= -length]
        i = min(fits)[1] if fits else min((-room, cost[i], i) for i, room in enumerate(rooms))[2]
        part = min(-length, rooms[i])
        placed.append((k, start, part, i, full[i] - rooms[i]))
        rooms[i] -= part
        cost[i] += balance.piece_cost(part)
        if part < -length:
            waiting = sorted([*waiting, (length + part, k, start + part)])
    return placed


@pytest.mark.parametrize("seed", range(8))
def test_balanced_equals_looking_at_every_sequence(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 1, 5, r.randint(1, 64), r.randint(1, 300)]) for _ in range(r.randint(0, 60))]
    got = balance.balanced(lengths, 64)
    assert got == plain_balance(lengths, 64)
    used = collections.Counter()
    for _, _, n, i, _ in got:
        used[i] += n
    assert [used[i] for i in range(len(used))] == balance.capacities(sum(lengths), 64)


def test_costs_are_closer_than_first_fit():
    r = random.Random(3)
    lengths = [min(400, int(r.expovariate(1 / 150)) + 1) for _ in range(2000)]  # a full-length document costs what it costs
    spread = []
    for pieces in (balance.balanced(lengths, 1024), first_fit(lengths, 1024)):
        cost, room = collections.Counter(), collections.Counter()
        for _, _, n, i, _ in pieces:
            cost[i] += balance.piece_cost(n)
            room[i] += n
        spread.append(np.std([cost[i] for i in cost if room[i] > 900]))
    assert spread[0] < 0.7 * spread[1]


def first_fit(lengths, size):
    rooms, out = [], []
    for k, n in enumerate(sorted(lengths, reverse=True)):
        i = next((i for i, room in enumerate(rooms) if room >= n), len(rooms))
        if i == len(rooms):
            rooms.append(size)
        out.append((k, 0, n, i, size - rooms[i]))
        rooms[i] -= n
    return out


@pytest.mark.parametrize("window", [300, 1 << 22])
def test_pack_balanced(spark, window):
    from tokenizers import Tokenizer

    r = random.Random(1)
    words = "the and of river stone light paper cloud <|endoftext|> é🎉".split()
    texts = {k: " ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 200]))) for k in range(60)}
    texts |= {60: None, 61: "", 62: "a" * 30_000, 63: " ".join(words * 400), None: "no id"}
    rows = [(k, t, "en", "s", 1) for k, t in texts.items()]
    got = balance.pack_balanced(frame(spark, rows).repartition(3), tokenizer_path(), window=window).collect()
    encode, pieces = Tokenizer.from_file(tokenizer_path()), collections.defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    for k, text in texts.items():
        ids, at = encode.encode(text or "", add_special_tokens=False).ids + [0], 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at:at + p.length]))
            at += p.length
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append(p)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0  # full or a power of two: nothing is padded
    assert balance.pack_balanced(frame(spark, []), tokenizer_path()).collect() == []


def test_repeated_rows_are_packed_as_often(spark):
    got = balance.pack_balanced(frame(spark, [(1, "same text", "en", "s", 1)] * 3), tokenizer_path()).collect()
    assert sum(p.length for p in got) == 3 * got[0].doc_tokens
