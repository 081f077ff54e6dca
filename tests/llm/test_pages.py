"""Blocks of web pages: broken markup, hidden elements, cut-off pages in linear time, and pages that teach nothing."""

import time

import pytest
from pyspark.sql import functions as F

from veilframe.llm import blocks


def texts(page):
    return [b.text for b in blocks.leaf_blocks(page)]


@pytest.mark.parametrize("page", [
    "<p>text</p><a " + 'k="v" ' * 150_000, "<p>text</p>" + '<a "' * 250_000, "<p>text</p>" + "<a x='" * 150_000 + ">",
    "<p>text</p>" + "<script " * 100_000, "<p>text</p>" + "<!-- " * 200_000, "<p>text</p><b " + '"' * 10_000,
    "<p>text</p>" + "<h1>" * 200_000, "<p>text</p>" + "</p><svg" * 100_000 + ">", "<p>text</p>" + "<li><b>" * 100_000])
def test_broken_pages_are_read_in_linear_time(page):
    began = time.time()
    assert texts(page)[0] == "text" and time.time() - began < 5


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p>a</p><svg class="i"/><p>b</p></article>', ["a", "b"]),
    ("<p>a<svg><title>t</title><path d='x'/></svg>b</p>", ["ab"]),
    ("<div><p>a</p><button>no</div><p>b</p>", ["a", "b"]),
    ("<p>a <select><option>x</select> b</p><p>c</p>", ["a b", "c"]),
    ("<div>a<template><p>no</p></template>b</div>", ["ab"]),
    ("<p>a<noscript><img><p>no</p></noscript>b", ["ab"]),
    ('<p title="' + "x" * 9000 + '>y">a</p>', ["a"]),
    ('<p title="a>b</p><p>c', ["b", "c"]),
    ("<p>a<!-- open > b", ["a"]), ("<p>a<script>x > y", ["a"]), ("<p>a</p><script>1</script >b", ["a", "b"]),
    ("a < b > c <p>d", ["a < b > c", "d"]), ("x <em", ["x"]), ("", []), ("&lt;p&gt;", ["<p>"]),
])
def test_markup(page, want):
    assert texts(page) == want


def test_pages_that_teach_nothing_keep_their_text(spark):
    rows = [(k, "u", f"<html><body><div>one {k}</div><div>two</div></body></html>") for k in range(5)] + [(9, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("blocks", F.lit("clash"))
    got = {r.page_id: r.text for r in blocks.main_text(df, blocks.fit_labeller(df)).collect()}
    assert got == {k: f"one {k}\ntwo" for k in range(5)} | {9: ""}
    assert blocks.main_text(df.limit(0), blocks.fit_labeller(df.limit(0))).collect() == []


def test_long_pages_are_read_whole(spark):
    body = "".join(f"<p>part {k}</p>" for k in range(3000))
    rows = [(k, "u", f"<body><nav>menu {k}</nav><article>{body if k == 1 else '<p>short text here.</p>'}</article><footer>end</footer></body>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in blocks.main_text(df, blocks.fit_labeller(df)).collect()}
    assert got[1] == "\n".join(f"part {k}" for k in range(3000)) and {got[k] for k in range(40) if k != 1} == {"short text here."}
