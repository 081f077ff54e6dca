"""Evaluation: annotations, span matching, scores, gaps, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 256  # characters per bin of the overlap join
FLOW = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}
# Text columns in order of preference.
TEXT_KEYS = ("source_text", "text", "content", "prompt", "sentence", "input", "document")


def row_text(df: DataFrame) -> Column:
    """The first non-blank of the known text columns the table has."""
    return F.coalesce(*[F.when(F.trim(k) != "", F.col(k)) for k in TEXT_KEYS if k in df.columns])


def annotations(privacy_mask: Column, spans: Column, entities: Column) -> Column:
    """``array<struct<label,value>>`` from whichever of the three shapes a row carries."""
    direct = F.filter(F.transform(privacy_mask, lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"))),
                      lambda m: m["label"].isNotNull() & m["value"].isNotNull())
    listed = F.transform(F.from_json(spans, "array<struct<label:string,text:string>>", FLOW),
                         lambda m: F.struct(m["label"].alias("label"), m["text"].alias("value")))
    typed = F.flatten(F.transform(F.from_json(entities, "array<struct<entity:string,types:array<string>>>", FLOW),
                                  lambda m: F.transform(m["types"], lambda t: F.struct(t.alias("label"), m["entity"].alias("value")))))
    return F.coalesce(direct, listed, typed)


def span_matches(gold: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of one class whose overlap is at least half of the shorter span.

    Spans meet in bins of ``BIN`` characters instead of all pairs per document; a pair is kept only
    in the first bin both touch.
    """
    def binned(df, side):
        first, last = F.floor(F.col("st") / BIN), F.floor((F.col("en") - 1) / BIN)
        return df.select(key, "entity", F.col("st").alias(f"{side}_st"), F.col("en").alias(f"{side}_en"),
                         F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))

    pairs = binned(gold, "g").join(binned(found, "p"), [key, "entity", "bin"])
    overlap = F.least("g_en", "p_en") - F.greatest("g_st", "p_st")
    shorter = F.least(F.col("g_en") - F.col("g_st"), F.col("p_en") - F.col("p_st"))
    here = F.col("bin") == F.floor(F.greatest("g_st", "p_st") / BIN)
    return pairs.filter(here & (overlap > 0) & (overlap * 2 >= shorter)).drop("bin")


def scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero),
            "f2": F.coalesce(F.try_divide(5 * p * r, 4 * p + r), zero)}


def detection_metrics(gold: DataFrame, found: DataFrame, key: str = "doc_id", by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """TP, FP, FN and scores overall, per entity and per each column of ``by``.

    All spans of both sides meet their matches in one join; a gold span counts as found or missed, a
    found one only where it is wrong.
    """
    m = span_matches(gold, found, key)
    matched = m.select(key, "entity", F.inline(F.array(*[F.struct(
        F.lit(side).alias("side"), F.col(f"{side}_st").alias("st"), F.col(f"{side}_en").alias("en")) for side in "gp"]))).distinct()
    on = [key, "entity", "side", "st", "en"]
    spans = gold.select(*by, *[c for c in on if c != "side"], F.lit("g").alias("side")).unionByName(
        found.select(*by, *[c for c in on if c != "side"], F.lit("p").alias("side")))
    kinds = spans.join(matched.withColumn("_hit", F.lit(True)), on, "left").select("entity", *by, F.when(
        F.col("_hit"), F.when(F.col("side") == "g", "tp")).otherwise(F.when(F.col("side") == "g", "fn").otherwise("fp")).alias("k"))
    counts = kinds.filter("k is not null").groupingSets([[], ["entity"], *[[c] for c in by]], "entity", *by).agg(
        *[F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")])
    return counts.select("entity", *by, "tp", "fp", "fn", *[
        F.round(c, 6).alias(n) for n, c in scores(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def expected_redaction(text: Column, values: Column) -> Column:
    """Annotated values replaced, longest first."""
    distinct = F.array_distinct(F.filter(values, lambda v: v != ""))
    ordered = F.array_sort(F.transform(distinct, lambda v: F.struct((-F.octet_length(v)).alias("n"), v.alias("v"))))
    return F.aggregate(ordered, text, lambda t, v: F.replace(t, v["v"], F.lit("[REDACTED]")))


def label_gaps(labels: DataFrame, supported: DataFrame) -> DataFrame:
    """Hits, sources and first row per label, its size bucket, whether it is supported, and the share of all hits so far.

    ``share`` is the part of all hits whose labels are supported, the same in every row.
    """
    stats = labels.groupBy("label").agg(
        F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("datasets"),
        F.countDistinct("source").alias("sources"), F.min("row_idx").alias("first_row"))
    bucket = F.when(F.col("hits") >= 8, "high").when(F.col("hits") >= 4, "medium").otherwise("low")
    known = supported.select("label", F.lit(True).alias("_s")).distinct()
    marked = stats.join(known, "label", "left").withColumn("supported", F.coalesce("_s", F.lit(False)))
    share = marked.agg(F.round(F.sum(F.when(F.col("supported"), F.col("hits")).otherwise(0)) / F.sum("hits"), 6)).scalar()
    return marked.select("label", "hits", "sources", "datasets", "first_row", bucket.alias("bucket"), "supported", share.alias("share"))


def expansion_candidates(labels: DataFrame, mapping: DataFrame, assertable: DataFrame, top: int = 100) -> DataFrame:
    """Mapped labels that no replay asserts yet, with the first row that has one, most hits first.

    ``mapping`` has ``label, entity``. The report takes the ``top`` ones, so one task orders no more than these.
    """
    stats = labels.groupBy("label").agg(F.count("*").alias("hits"), F.min(F.struct("source", "row_idx")).alias("at"))
    open_ = mapping.join(assertable.select("label"), "label", "left_anti").join(stats, "label")
    best = open_.orderBy(F.col("hits").desc(), "label").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.col("hits").desc(), "label")).alias("rank"), "label", "entity", "hits",
                       F.col("at.source").alias("dataset"), F.col("at.row_idx").alias("row_idx"))


def parity(current: DataFrame, baseline: DataFrame, key: str, value: str) -> DataFrame:
    b = baseline.select(key, F.col(value).alias("_b"))
    return current.join(b, key, "full").select(
        key, (F.coalesce(value, F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta"))


def gates(required: DataFrame, present: DataFrame) -> DataFrame:
    """A level passes when every output it requires is present."""
    have = present.select(F.col("output")).distinct().withColumn("_h", F.lit(True))
    return required.join(have, "output", "left").groupBy("level", "blocking").agg(F.every(F.col("_h").isNotNull()).alias("passed"))
