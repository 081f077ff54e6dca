"""Operators against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import blocks, components, decontam, embeddings, minhash, packing, pii, recurrent, rules, toxicity, warc
from veilframe.llm.queries import tokenizer_path

WORDS = "the and of river stone light paper cloud window garden market silver thunder orange gentle number".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "."]) for _ in range(n))


def frame(spark, texts, extra=True):
    rows = [(k, t, k) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    return df.withColumns({"label": F.lit("x"), "row": F.lit(1), "root": F.lit(2)}) if extra else df


ODD = [None, "", " \t\n", "one", "two words", "é🎉 x", "a" * 30_000, prose(1), prose(1), prose(1).upper()]


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def least_reachable(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)  # many blocks in the large cluster
    texts = list(ODD)
    for k in range(40):
        words = prose(2, 120).split()
        for j in random.Random(k).sample(range(120), k % 5):
            words[j] = f"changed{k}{j}"
        texts.append(" ".join(words))
    sets = [shingles(t, size) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = least_reachable(len(sets), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), size, percent).collect()}
    assert [(got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) for k in range(len(texts))] == [
        (len(s), want[k], want[k] == k) for k, s in enumerate(sets)]
    assert minhash.near_duplicates(frame(spark, []), size, percent).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    rows = minhash.near_duplicates(nulls, size, percent).collect()
    assert len(rows) == 4 and all(r["kept"] for r in rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 160), 100)}


def test_near_vectors(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((60, 16))
    rows = [*base, *(base[:30] + 0.08 * r.standard_normal((30, 16))), base[0], base[0] * 3]
    x = [list(map(float, np.float32(v))) for v in rows] + [None, [], [0.0] * 16, [1.0, float("nan")] * 8, [1.0] * 3, [None] * 16]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    n = len(rows)
    unit = np.array([np.float32(v).astype(float) for v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    want = least_reachable(len(x), [(a, b) for a in range(n) for b in range(a) if near[a, b]])
    got = {g["vec_id"]: g for g in embeddings.near_vectors(df).collect()}
    assert [got[k]["n_links"] for k in range(len(x))] == [int(near[k].sum()) - 1 if k < n else 0 for k in range(len(x))]
    assert [got[k]["component_id"] for k in range(len(x))] == want
    assert embeddings.near_vectors(df.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checked(kind, v):
    d = re.sub(r"\D", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if checked(kind, m[0]))


def test_private_spans(spark):
    texts = [*ODD, "a@b.c@d.e_x@e.f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "+1 (555) 123-4567 +123", "é🎉x a.b@c.d 4111 1111 1111 1111",
             "x" * 20_000 + "@y", "1" * 20_000, "+1" + "(" * 20_000, ". ".join(["a@b.cd"] * 900)]
    got = {r["doc_id"]: r["hits"] for r in pii.find_base(frame(spark, texts)).collect()}
    assert {k: [(h["st"], h["k"], h["en"]) for h in v] for k, v in got.items()} == {k: base_spans(t) for k, t in enumerate(texts)}
    assert pii.private_spans(frame(spark, [])).count() == 0


def test_disclosing_terms_are_removed(spark):
    told = [f"{prose(k, 20)} zephyrine called card 4111 1111 1111 1111 {prose(90 + k, 20)}" for k in range(12)]
    df = frame(spark, told + [prose(200 + k) for k in range(60)] + ["zephyrine", None], extra=False)
    rows = {r["doc_id"]: r for r in pii.private_spans(df, pii.Thresholds(5, 2.0)).collect()}
    assert all("zephyrine" in [h["v"] for h in rows[k]["terms"]] for k in range(12)) and rows[20]["terms"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, pii.Thresholds(5, 2.0)).collect()}
    assert "zephyrine" not in clean[0] and "4111" not in clean[0] and clean[20] == prose(208) and clean[73] is None


def test_disclosing_terms_of_values_and_kinds_in_whole_documents(spark):
    far = [f"zephyrine {prose(k, 40)} card 4111 1111 1111 1111 {prose(90 + k, 20)}" for k in range(12)]
    kind = [f"{prose(k, 40)} quillwort {prose(50 + k, 40)} +1 (555) 010-{1000 + k} box" for k in range(12)]
    mail = [f"{prose(70 + k, 40)} name{k}@quibble.org" for k in range(3)]
    df = frame(spark, far + kind + mail + [prose(200 + k) for k in range(60)] + ["quibble", None], extra=False)
    rows = {r["doc_id"]: [h["v"] for h in r["terms"]] for r in pii.private_spans(df).collect()}
    assert all("zephyrine" in rows[k] and "quillwort" in rows[12 + k] for k in range(12))
    assert not any(rows[k] for k in range(24, 89))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "zephyrine" not in clean[3] and "quillwort" not in clean[15] and "[CARD]" in clean[3] and "[PHONE]" in clean[15]
    copies = frame(spark, ["zephyrine x 4111 1111 1111 1111"] * 12 + [prose(k) for k in range(60)], extra=False)
    assert not any(r["terms"] for r in pii.private_spans(copies).collect())


def test_a_value_of_many_documents_has_terms(spark):
    told = [f"{prose(k, 30)} zephyrine {prose(90 + k, 30)} 4111 1111 1111 1111" for k in range(60)]
    df = frame(spark, told + [prose(200 + k) for k in range(60)], extra=False)  # half of all: at most one bit
    rows = {r["doc_id"]: [h["v"] for h in r["terms"]] for r in pii.private_spans(df).collect()}
    assert all(rows[k] == ["zephyrine"] for k in range(60)) and not any(rows[k] for k in range(60, 120))


def test_packing(spark):
    from tokenizers import Tokenizer

    size = 64
    texts = [*ODD, "a  \n b   c <|endoftext|> d ", "x's  don't\xa0 y"] + [prose(k, k) for k in range(40)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(frame(spark, texts), tokenizer_path(), size).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for p, r in enumerate(sorted(by[k], key=lambda r: r["piece"])):
            part = np.array(ids[at:at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (p, at, zlib.crc32(part))
            assert r["length"] == size or p == 0
            at += r["length"]
        assert at == len(ids)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for used in bins.values():
        end = 0
        for offset, length in sorted(used):
            assert offset == end
            end += length
        assert end <= size
    rooms: list[int] = []
    for length in sorted((r["length"] for r in rows), reverse=True):
        room = min((x for x in rooms if x >= length), default=None)
        if room is None:
            rooms.append(size - length)
        else:
            rooms[rooms.index(room)] -= length
    assert len(bins) == len(rooms)
    assert packing.pack(frame(spark, []), tokenizer_path(), size).count() == 0


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    rnd, path = random.Random(3), tokenizer_path()
    assert packing.merges_by_id(path)
    texts = ["", " ", "x" * 50_000, " " * 50_000 + "a", "\n" * 50_000, "a<|endoftext|> b", "é" * 9_000, " \t" * 9_000 + "b", "1 !" * 9_000]
    texts += ["".join(rnd.choice(" a\n\r'stllé漢\u0085\u3000\x1c!9²🎉\u0301") for _ in range(900)) for _ in range(60)]
    texts += ["".join(chr(rnd.choice((rnd.randrange(0xd800), rnd.randrange(0xe000, 0x110000)))) for _ in range(400)) for _ in range(60)]
    tokenizer = Tokenizer.from_file(path)
    plain = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(packing.token_ids(texts, path, True)) == plain and list(packing.token_ids(texts, path, False)) == plain


def test_archives_round_trip(spark):
    big = "<p>same</p>" * 200
    rows = [(1, "u", big), (2, None, big), (3, "u\r\nX: y", big), (4, "u", None), (5, "u", "WARC/1.1\r\n\x1f"), (None, "u", "z"), (6, "u", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(0))
    got = {r["record_id"]: r for r in warc.archive_pages(df).collect()}
    assert len(got) == 7 and got["<urn:page:3>"]["kind"] == "response"
    assert [got[f"<urn:page:{k}>"]["refers_to"] for k in (1, 2, 4)] == ["<urn:page:3>", "<urn:page:3>", None]
    for k, _, html in rows:
        r = got[f"<urn:page:{'' if k is None else k}>"]
        payload = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    assert warc.archive_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("form", [bytes, gzip.compress])
def test_salvage_steps_over_damage(form):
    parts = [form(warc.record_bytes("response", f"<{k}>", "u", "d", bytes([65 + k]) * 90, b"")) for k in range(5)]
    data = bytearray(b"".join(parts))
    data[len(parts[0]) + len(parts[1]) - 20] ^= 0xFF
    found = list(warc.salvage(b"junk" + bytes(data) + parts[0][:40]))
    assert [f and f["warc-record-id"] for _, _, f, _ in found] == [None, "<0>", None, "<2>", "<3>", "<4>", None]
    assert found[0][0] == 0 and found[-1][1] == 4 + len(data) + 40 and all(a[1] == b[0] for a, b in zip(found, found[1:]))


def test_revisits_of_one_page_id_with_several_payloads(spark):
    a, b, c = ("<p>a</p>" * 200, "<p>b</p>" * 200, "<p>c</p>" * 200)
    rows = [(1, "u", a), (1, "u", b), (1, "u", c), (2, "u", a), (3, "u", b)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["record_id"], r["kind"], r["refers_to"] or "", r["payload_digest"]) for r in got) == sorted(
        (f"<urn:page:{k}>", kind, to, hashlib.sha1(x.encode()).hexdigest()) for k, kind, to, x in [
            (1, "revisit", "<urn:page:2>", a), (1, "revisit", "<urn:page:3>", b), (1, "response", "", c),
            (2, "response", "", a), (3, "response", "", b)])


def test_salvage_within_members():
    parts = [warc.record_bytes("response", f"<{k}>", "u", "d", random.Random(k).randbytes(3000), b"") for k in range(5)]

    def ids(data):
        return [f and f["warc-record-id"] for _, _, f, _ in warc.salvage(data)]

    whole = gzip.compress(b"".join(parts))
    found = list(warc.salvage(parts[0] + whole + gzip.compress(parts[1])))
    assert [f["warc-record-id"] for _, _, f, _ in found] == ["<0>", "<0>", "<1>", "<2>", "<3>", "<4>", "<1>"]
    assert [a - len(parts[0]) for a, *_ in found[1:6]] == [sum(map(len, parts[:k])) for k in range(5)]
    bad = bytearray(b"".join(parts))
    bad[len(parts[0]) + 2000] ^= 0xFF
    assert ids(gzip.compress(bytes(bad))) == ["<0>", None, "<2>", "<3>", "<4>"]
    assert [x for x in ids(whole[:-4000]) if x] == ["<0>", "<1>", "<2>"]  # cut off
    broken = bytearray(whole)
    broken[-1] ^= 0xFF  # the length at the end
    assert [x for x in ids(bytes(broken) + gzip.compress(parts[2])) if x] == ["<0>", "<1>", "<2>", "<3>", "<4>", "<2>"]
    long = warc.record_bytes("response", "<l>", "u" * (6 << 20), "d", b"x", b"")
    assert ids(long) == ids(gzip.compress(long)) == ["<l>"]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(recurrent, "EVERY", 1)
    monkeypatch.setattr(recurrent, "ROUNDS", 4)
    topics = [random.Random(k) for k in range(150)]  # each text keeps to one half of the words
    texts = [*ODD, *(" ".join(r.choice(WORDS[k % 2 * 8:k % 2 * 8 + 8]) for _ in range(80)) for k, r in enumerate(topics))]
    df = frame(spark, texts)
    train = df.filter("doc_id % 5 <> 0")
    model = recurrent.fit_language_model(train)
    got = {r["doc_id"]: r for r in recurrent.score_documents(df, model).collect()}
    counts = collections.Counter(w for k, t in enumerate(texts) if k % 5 for w in (t or "").encode().lower().split())
    n = sum(k % 5 > 0 for k in range(len(texts)))
    total, distinct = sum(counts.values()) + n, len(counts) + 1
    for k, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(counts[w] for w in words), n])
        assert got[k]["n_tokens"] == len(words) + 1 and got[k]["n_known"] == sum(w in counts for w in words) + 1
        assert got[k]["train_tokens"] == total and math.isclose(got[k]["base_score"], base, rel_tol=1e-9)
        assert got[k]["score"] < 0
    held = [got[k] for k in range(0, len(texts), 5) if k >= 10]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert recurrent.score_documents(frame(spark, []), recurrent.fit_language_model(frame(spark, []))).count() == 0


def test_recurrence_learns_from_every_document(spark):
    topics = [random.Random(k) for k in range(150)]
    texts = [" ".join(r.choice(WORDS[k % 2 * 8:k % 2 * 8 + 8]) for _ in range(80)) for k, r in enumerate(topics)]
    df = frame(spark, texts, extra=False).filter("pmod(xxhash64(doc_id, 3), 8) <> 0")  # those a fit on every 8th left out
    model = recurrent.fit_language_model(df)
    plain = recurrent.Model(model.vocabulary, model.counts, recurrent.Network(model.vocabulary).p)
    told, untold = (sum(r["score"] for r in recurrent.score_documents(df, m).collect()) for m in (model, plain))
    assert told > untold


def test_held_counts_and_joined_counts_agree(spark, monkeypatch):
    df = frame(spark, [prose(k, 50) + f" rare{k} é{k}." for k in range(40)], extra=False)
    whole = {r["doc_id"]: r for r in recurrent.score_documents(df, recurrent.fit_language_model(df)).collect()}
    monkeypatch.setattr(recurrent, "HELD", 30)
    monkeypatch.setattr(recurrent, "OWN", 20)
    part = {r["doc_id"]: r for r in recurrent.score_documents(df, recurrent.fit_language_model(df)).collect()}
    assert all(math.isclose(whole[k]["base_score"], part[k]["base_score"]) and whole[k]["n_known"] == part[k]["n_known"] for k in whole)


def _language_network(own=30, seed=3):
    r = np.random.default_rng(seed)
    counts = np.sort(r.integers(1, 99, own))[::-1]
    network = recurrent.Network(recurrent.Vocabulary({}, counts, own, np.zeros(own, int), 9, int(counts.sum()) + 9, own + 1,
                                                     np.full(recurrent.SHAPES, 5), np.full(recurrent.SHAPES, 2)))
    parts = [np.append(r.integers(0, own + 1 + recurrent.SHAPES, n), own).astype(np.int16) for n in (70, 3, 1, 5, 40, 2, 0, 9, 4, 33)]
    return network, parts, recurrent.Texts(np.concatenate(parts), np.cumsum([0, *map(len, parts)]))


def test_scores_of_lanes_equal_scores_of_single_texts(monkeypatch):
    network, parts, texts = _language_network()
    p, end = network.p, network.own + 1

    def alone(text):  # one step after the other, in double precision
        h, total, size = np.zeros(recurrent.STATE), 0.0, recurrent.STATE
        for x in text:
            logits = h @ p["C"] + p["c"]
            k = network.class_of[x]
            total += logits[k] - np.log(np.exp(logits).sum())
            if x < end:
                group = network.groups[k]
                logits = p["W"][group] @ h + p["w"][group]
                total += logits[network.place[x]] - np.log(np.exp(logits).sum())
            a, u = p["E"][x].astype(float), h @ p["U"]
            z, g = (1 / (1 + np.exp(-(a[i:i + size] + u[i:i + size]))) for i in (0, size))
            n = np.tanh(a[2 * size:] + g * u[2 * size:])
            h = n + z * (h - n)
        return total

    expected = [alone(t) for t in parts]
    for lanes in (1, 3, 256):
        monkeypatch.setattr(recurrent, "LANES", lanes)
        assert np.allclose(network.score(texts), expected, rtol=1e-4)


def test_gradients_of_the_language_network(monkeypatch):
    network, parts, _ = _language_network()
    short = [t for t in parts if len(t) < 7]
    texts = recurrent.Texts(np.concatenate(short), np.cumsum([0, *map(len, short)]))
    (x, _, begin), = network.lanes(texts, 2)  # several texts a lane, all in one window
    values, _, count = network.gradients(np.zeros((recurrent.STATE, 2), np.float32), x, begin)
    assert count == len(texts.entries) and begin.sum() == len(short)
    found = recurrent._views(values, network.p)
    for name, value in network.p.items():
        for at in np.argsort(-np.abs(found[name]).ravel())[:5]:
            at, sums = np.unravel_index(at, value.shape), []
            old = value[at]
            for step in (0.02, -0.02):
                value[at] = old + step
                sums.append(-network.score(texts).sum())
            value[at] = old
            assert math.isclose((sums[0] - sums[1]) / 0.04, found[name][at], rel_tol=0.02, abs_tol=2e-3), (name, at)


def test_lanes_are_kept_full():
    r = np.random.default_rng(5)
    sizes = np.append(r.integers(1, 200, 400), 2000)
    texts = recurrent.Texts(np.zeros(sizes.sum(), np.int16), np.cumsum([0, *sizes]))
    windows = list(recurrent.Network.lanes(texts, 16))
    assert sum(int((x >= 0).sum()) for x, *_ in windows) == sizes.sum()
    assert sum(int(begin.sum()) for *_, begin in windows) == len(sizes)
    assert len(windows) <= max(sizes.sum() / 16 + 200, 2000) / recurrent.WINDOW + 1  # not the longest of each 16 texts


def test_windows_of_few_lanes_hold_as_many_entries():
    sizes = np.append(np.full(64, 100), 20_000)
    r = np.random.default_rng(5)
    texts = recurrent.Texts(r.integers(0, 9, sizes.sum()).astype(np.int16), np.cumsum([0, *sizes]))
    windows = list(recurrent.Network.lanes(texts, 16, stretch=True))
    assert len(windows) <= sizes.sum() / (16 * recurrent.WINDOW) + 100 / recurrent.WINDOW + 30  # not 20,000 / WINDOW
    assert all(x.size <= 16 * recurrent.WINDOW for x, *_ in windows)
    assert sum(int((x >= 0).sum()) for x, *_ in windows) == sizes.sum() and sum(int(b.sum()) for *_, b in windows) == 65
    long = np.concatenate([x[(rows == 64) & (x >= 0)] for x, rows, _ in windows])
    assert np.array_equal(long, texts.entries[-20_000:])
    assert all(len(x) == recurrent.WINDOW for x, *_ in recurrent.Network.lanes(texts, 16))  # a fit's steps stay as they are


def test_softmax_of_large_weights():
    network, _, texts = _language_network()
    small = network.score(texts)
    network.p["c"] += 200  # the same for all classes, far beyond the powers of single precision
    network.p["w"] += 200
    assert np.allclose(network.score(texts), small, rtol=1e-3)


def test_words_are_split_and_classed_by_bytes():
    texts = [*ODD, "", None, " \t\x0b\x0c a\x1cB\x85c\u00a0D \r\n", "É.\u2028é! x? longer-word, ÀÉ, İI", "\n", "end"]
    for column in (pa.array(texts, pa.string()), pa.array(["x y", *texts, "z"], pa.string()).slice(1, len(texts))):
        words, bounds = recurrent.words_of(column)
        expected = [(t or "").encode().lower().split() for t in texts]
        assert words.cast(pa.binary()).to_pylist() == sum(expected, [])
        assert bounds.tolist() == [0, *np.cumsum([len(t) for t in expected])]
        assert recurrent.shapes(words).tolist() == [
            min(len(w) // 3, 3) * 4 + (not w.isascii()) * 2 + w.endswith((b".", b",", b"!", b"?", b";", b":")) for w in sum(expected, [])]


def test_word_counts_of_many_parts(spark, monkeypatch):
    texts = [*ODD, None, *(prose(k, 50) + f" rare{k % 7} É{k}." for k in range(60))]
    expected = collections.Counter(w.decode() for t in texts for w in (t or "").encode().lower().split())
    for size in (1, 300, recurrent.SPLIT_BYTES):
        monkeypatch.setattr(recurrent, "SPLIT_BYTES", size)
        got = recurrent.word_counts(frame(spark, texts, extra=False)).collect()
        assert {r["word"]: r["c"] for r in got} == expected and len(got) == len(expected)


def test_parts_without_words_are_encoded_like_others(spark, monkeypatch):
    texts = ["", None, " \n", "the of rare the rare", "", "of É."]
    train = frame(spark, texts, extra=False)
    vocabulary = spark.sparkContext.broadcast(recurrent.learnt_counts(train.filter("doc_id <> 3"))[0])
    found = []
    for size in (1, 20, recurrent.SPLIT_BYTES):
        monkeypatch.setattr(recurrent, "SPLIT_BYTES", size)
        found.append({r["doc_id"]: r for r in recurrent.encoded(train.coalesce(1), vocabulary, F.lit(True)).collect()})
    for k in range(len(texts)):
        assert len({(r[k]["x"], r[k]["score"], r[k]["base_score"], r[k]["n_known"]) for r in found}) == 1
        assert all(sorted(zip(r[k]["rest"], r[k]["many"])) == ([("rare", 2), ("the", 2)] if k == 3 else []) for r in found)


def test_each_text_is_encoded_once_for_all_passes(spark, monkeypatch):
    df, calls = frame(spark, [prose(k, 50) + f" rare{k} é{k}." for k in range(40)], extra=False), []
    plain, fit = recurrent.encoded, recurrent.fit_recurrence
    monkeypatch.setattr(recurrent, "encoded", lambda *a: calls.append("encoded") or plain(*a))
    monkeypatch.setattr(recurrent, "fit_recurrence", lambda rows, v: calls.append("text" in rows.columns) or fit(rows, v))
    got = {r["doc_id"]: r for r in recurrent.fit_and_score(df, F.col("doc_id") % 5 != 0).collect()}
    assert calls == ["encoded", False]
    apart = recurrent.score_documents(df, recurrent.fit_language_model(df.filter("doc_id % 5 <> 0"))).collect()
    assert len(got) == len(apart) == 40
    for r in apart:
        assert got[r["doc_id"]]["n_known"] == r["n_known"] and math.isclose(got[r["doc_id"]]["base_score"], r["base_score"])


def test_gradients_of_the_block_labeller():
    model, r = blocks.Labeller(), np.random.default_rng(1)
    data = (r.random((2, 5, blocks.PATHS), np.float32), r.random((2, 5, blocks.WORDS), np.float32), r.random((2, 5, blocks.EXTRA), np.float32))
    y, mask = np.array([[1, 0, 1, -1, 0], [0, 1, 1, 0, 0]], np.float32), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradients(*data, y, mask)
    for name in ("P", "W", "Xf", "Hb", "Bf", "out"):
        at = np.unravel_index(int(np.abs(g[name]).argmax()), g[name].shape)
        old, found = model.p[name][at], []
        for step in (1e-2, -1e-2):
            model.p[name][at] = old + step
            found.append(model.gradients(*data, y, mask)[0])
        model.p[name][at] = old
        assert math.isclose((found[0] - found[1]) / 2e-2, g[name][at], rel_tol=0.05, abs_tol=1e-4), name


def test_main_text(spark):
    def page(k):
        return (f"<html><head><title>t{k}</title><script>var a='<p>';</script></head><body><nav><ul><li><a href=x>home</a></li></ul></nav>"
                f"<div class=\"ad\">{prose(k, 5)}</div><article><h1>Head {k}</h1><p><b>{prose(k)}<br><p>{prose(k + 1)} &amp; more</article>"
                f"<footer>&copy; {prose(k, 4)}</footer></body></html>")

    html = [page(k) for k in range(60)]
    rows = [(k, "u", h) for k, h in enumerate(html)] + [(90, None, None), (91, "u", ""), (None, "u", html[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in blocks.main_text(df, blocks.fit_labeller(df)).collect()}
    assert all(got[k]["text"] == f"Head {k}\n{prose(k)}\n{prose(k + 1)} & more" for k in range(60))
    assert got[90]["text"] == got[91]["text"] == "" and got[None]["text"] == got[0]["text"]


def test_quality_rules(spark):
    r = random.Random(4)
    texts = [prose(k, 60) if k % 3 else " ".join(w + "%%%" for w in prose(k, 40).split()) for k in range(400)] + ODD
    labels = spark.createDataFrame([(k, int(k % 3 > 0) if r.random() > 0.02 else 0) for k in range(300)] + [(7, None), (None, 1)], "doc_id long, quality int")
    df = frame(spark, texts)
    model = rules.fit_quality(df, labels)
    got = {x["doc_id"]: x["__q"] for x in rules.with_quality(df, model, score="__q").collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[k] >= 0.7) == (k % 3 > 0) for k in range(300, 400)) >= 97
    constant = rules.fit_quality(df, labels.limit(0))
    assert {x["s"] for x in rules.with_quality(df.drop("score"), constant, score="s").collect()} == {0.5}


def test_toxicity(spark):
    def text(k):
        words = prose(k, 60).split()
        for j in random.Random(k).sample(range(60), 3 if k % 3 == 0 else 0):
            words[j] = ["blorgface", "snarkwit", "dunderclot"][j % 3]
        return " ".join(words)

    texts = [text(k) for k in range(600)] + ODD
    df = frame(spark, texts)
    model = toxicity.fit_toxicity(df, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(500)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in range(500, 600)) >= 95
    none = toxicity.fit_toxicity(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.toxicity(df, none).collect()} == {0.5}


def test_contamination(spark):
    items = [prose(1000 + k, 40) for k in range(30)] + [None, "", "tiny item"]
    r = random.Random(9)

    def noisy(t):
        s = list(t)
        for _ in range(len(s) // 25):
            s[r.randrange(len(s))] = r.choice("qxz")
        return "".join(s)

    texts = [prose(5000 + k, 100) for k in range(30)] + [f"{prose(k, 50)}  {noisy(items[k]).upper()}\n{prose(k + 1, 30)}" for k in range(30)] + [
        "Tiny  ITEM", "a tiny item here"] + ODD
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contamination(frame(spark, texts), bench).collect()}
    assert got == {(30 + k, k) for k in range(30)} | {(60, 32)}
    assert decontam.contamination(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontam.decontaminated(frame(spark, texts), bench).count() == len(texts) - 31


def test_benchmark_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BYTES", 400)
    items = [prose(k, 40) for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contamination(frame(spark, items, False), bench).collect()}
    assert got == {(k, k) for k in range(12)}
