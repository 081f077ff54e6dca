"""Stages of the corpus pipeline on null and repeated ids, clashing columns, chains of copies, and empty tables."""

import collections
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veilframe.llm import pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    return " ".join(f"word{seed}x{k}" for k in range(n))


def frame(spark, rows):
    """Rows of id and text, with columns whose names the stages might use themselves."""
    full = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
    return spark.createDataFrame(full, DOCS).withColumns({c: F.lit(c) for c in ("row", "score", "component_id", "share", "__key", "_row")})


def labelled(spark, path, rows=()):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(60)))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_one_row_of_each_group_stays(spark):
    same, alone = prose(1), prose(2)
    rows = [(None, same), (None, same), (5, same), (5, same), (7, same), (7, alone), (8, prose(3)), (8, prose(3)), (None, prose(4)),
            (None, prose(4)), (9, ""), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == collections.Counter([(5, same), (7, alone), (8, prose(3)), (None, prose(4)), (9, ""), (10, None)])


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(7)
    rows = []
    for k in range(60):
        words = prose(k // 12, 80).split()
        for j in r.sample(range(80), r.choice([0, 1, 2, 4, 9])):
            words[j] = f"other{k}{j}"
        rows.append((r.choice([None, k % 20, k]), " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = collections.Counter()
    for g in {find(i) for i in range(60)}:
        members = [i for i in range(60) if find(i) == g]
        want[min(((rows[i][0] is None, rows[i][0] or 0) for i in members))] += 1
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    kept = got.collect()
    assert collections.Counter((x.doc_id is None, x.doc_id or 0) for x in kept) == want
    assert {(x.doc_id, x.text) for x in kept} <= set(rows) and kept[0].row == "row" and kept[0]["__key"] == "__key"


def test_a_chain_of_loosely_alike_texts_stays_apart(spark):
    """Neighbours share four tenths of their shingles: they meet in bands, and none is a copy."""
    words = [f"w{k}" for k in range(4000)]
    rows = [(k, " ".join(words[k * 43:k * 43 + 100])) for k in range(80)]
    assert corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").count() == 80


def test_quality_keeps_all_without_labels(spark, tmp_path):
    df = frame(spark, [(1, prose(1)), (2, None)])
    out = corpus_pipeline.quality(spark, df, labelled(spark, tmp_path))
    assert out.count() == 2 and out.columns == df.columns


def test_quality_keeps_clashing_columns(spark, tmp_path):
    good = [(k, f"A clear sentence number {k} is here. It has a second part, and it ends well.") for k in range(60)]
    bad = [(100 + k, f"$$$ ### {k} !!! >>> ###") for k in range(60)]
    path = labelled(spark, tmp_path, [(k, int(k < 100), 0) for k, _ in good + bad])
    df = frame(spark, good + bad)
    out = corpus_pipeline.quality(spark, df, path)
    kept = out.collect()
    assert {x.doc_id for x in kept} == {k for k, _ in good} and out.columns == df.columns and kept[0].score == "score"


def test_decontaminate_private_data_and_pack(spark, tmp_path):
    path = labelled(spark, tmp_path)
    item = " ".join(f"bench{k}" for k in range(60))
    df = frame(spark, [(1, prose(1) + " " + item + " " + prose(2)), (2, prose(3)), (3, None), (4, ""), (5, "write to bob@example.com now")])
    clean = corpus_pipeline.decontaminate(spark, df, path)
    assert {x.doc_id for x in clean.collect()} == {2, 3, 4, 5}
    masked = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.private_data(spark, clean, path).collect()}
    assert "bob@example.com" not in masked[5][0] and masked[5][1] == len(masked[5][0]) and masked[2][0] == prose(3)
    pieces = corpus_pipeline.pack(spark, clean, path).collect()
    assert {p.doc_id for p in pieces} == {2, 3, 4, 5} and all(p.length <= 2048 for p in pieces)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_tables(spark, tmp_path, name):
    path = labelled(spark, tmp_path, [(1, 1, 0)])
    assert dict(pipeline.STAGES)[name](spark, frame(spark, []), path).collect() == []


def test_run_applies_all_stages(spark, tmp_path):
    good = [(k, f"A clear sentence number {k} is here, with words like {prose(k, 8)}. It ends well.") for k in range(60)]
    bad = [(100 + k, f"$$$ ### {k} !!! >>> ###") for k in range(60)]
    path = labelled(spark, tmp_path, [(k, int(k < 100), 0) for k, _ in good + bad])
    copies = [(200 + k, good[k][1]) for k in range(5)]
    frame(spark, good + bad + copies).write.parquet(f"{path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p.doc_id for p in pieces} == {k for k, _ in good}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "private_data", "pack"]
