"""Named-entity spans: what to send to a model, how to read its labels, how to merge its hits.

The model itself is a plug-in: any callable from texts to spans, loaded once per task.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.arrays import let
from veilframe.functions.regex import jvm

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Sub-batch size, threshold, hit priority and the category of each entity.
BATCH = 32
THRESHOLD = 0.7
PRIORITY = 200
ENTITY_CATEGORY = {"person": "pii", "organization": "corporate_markers"}
ENTITY_SPANS = T.ArrayType(T.StructType([
    T.StructField("entity", T.StringType()), T.StructField("st", T.IntegerType()), T.StructField("en", T.IntegerType()),
    T.StructField("score", T.DoubleType()), T.StructField("lang", T.StringType())]))
RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("spans", ENTITY_SPANS)])


def is_candidate(text: Column) -> Column:
    """Worth a model run: three bytes, a letter, and no date- or id-like start."""
    dated = text.rlike(r"(?U)^\s*[0-9]") & text.rlike("[:/-]")
    return (F.octet_length(text) >= 3) & text.rlike(r"\p{IsAlphabetic}") & ~dated


def skipped_pointer(ptr: Column, path_class: Column, roles: Column, skip_patterns: tuple[str, ...] = ()) -> Column:
    """Tool definitions and system messages of chat requests, and pointers with a skipped segment.

    ``roles`` is the array of message roles.
    """
    index = F.regexp_extract(ptr, r"^/messages/(\d+)/content(?:/|$)", 1)
    role = F.try_element_at(roles, F.when(index != "", F.expr("1") + index.cast("int")))
    system = F.coalesce(F.lower(role) == "system", F.lit(False))
    skip = (path_class == "llm") & ((ptr == "/tools") | F.startswith(ptr, F.lit("/tools/")) | system)
    for pattern in skip_patterns:
        skip = skip | _any_segment(ptr, pattern)
    return skip


def _any_segment(ptr: Column, pattern: str) -> Column:
    return F.exists(F.split(ptr, "/"), lambda s: s.rlike(jvm(pattern)))


def language(text: Column) -> Column:
    cyrillic, ascii_ = F.regexp_count(text, F.lit(r"[Ѐ-ӿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(cyrillic > ascii_, "ru").when(ascii_ > 0, "en").otherwise("unknown")


def recognize_distinct(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """Adds ``status`` and ``ner_spans``: every distinct text is sent to the model once.

    ``load`` builds the model inside the task. A failing batch marks its texts instead of the job. A null
    text is kept with status ``ok`` and no spans. Spans meet their rows by the hash of the text.
    """
    @F.pandas_udf(RESULT)
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            rows = []
            for i in range(0, len(texts), BATCH):
                part = texts.iloc[i:i + BATCH].tolist()
                try:
                    rows += [("ok", spans) for spans in model(part)]
                except Exception:  # noqa: BLE001 - reported per row as a degraded result
                    rows += [("failed", None)] * len(part)
            yield pd.DataFrame(rows, columns=["status", "spans"])

    texts = df.select(F.col(column).alias("_t")).filter("_t is not null").distinct()
    found = texts.select(F.sha2("_t", 256).alias("_h"), infer(F.col("_t")).alias("_r"))
    return df.withColumn("_h", F.sha2(column, 256)).join(found, "_h", "left").select(
        *df.columns, F.when(F.col(column).isNull(), "ok").otherwise(F.col("_r.status")).alias("status"),
        F.when(F.col(column).isNull(), F.array().cast(ENTITY_SPANS)).otherwise(F.col("_r.spans")).alias("ner_spans"))


def bio_spans(tokens: Column, threshold: float = 0.0, scored: bool = True) -> Column:
    """Spans of a text from its tokens (``label, st, en, logits`` in order): B opens one, a changed I opens one too.

    ``array<struct<entity,first_token,last_token,st,en,score>>``, where the score is the mean probability of the
    labels chosen in the span; spans below ``threshold`` are left out. Without ``scored`` labels alone are read, and there
    is neither score nor threshold. All within the row; tokens outside of spans are only looked at once.
    """
    def entity(t: Column) -> Column:
        return F.substring(t["label"], F.lit(3), F.char_length(t["label"]))

    def decode(toks: Column) -> Column:
        def opened(idx: Column) -> Column:
            def opens(i: Column, k: Column) -> Column:
                before = toks[F.greatest(i - 1, F.lit(0))]
                goes_on = (k > 0) & (idx[F.greatest(k - 1, F.lit(0))] == i - 1) & F.startswith(toks[i]["label"], F.lit("I-")) & (
                    entity(before) == entity(toks[i]))
                return F.when(~goes_on, k)

            def told(p: Column, k: Column, starts: Column) -> Column:
                first, last = toks[idx[p]], idx[F.coalesce(F.try_element_at(starts, k + 2), F.size(idx)) - 1]
                out = [entity(first).alias("entity"), idx[p].alias("first_token"), last.alias("last_token"),
                       first["st"].alias("st"), toks[last]["en"].alias("en")]
                if not scored:
                    return F.struct(*out)
                total = F.aggregate(F.slice(toks, idx[p] + 1, last - idx[p] + 1), F.lit(0.0), lambda a, t: a + chosen_probability(t["logits"]))
                return F.struct(*out, (total / (last - idx[p] + 1)).alias("score"))

            return let(F.array_compact(F.transform(idx, opens)), lambda starts: F.transform(starts, lambda p, k: told(p, k, starts)))

        inside = F.transform(toks, lambda t, i: F.when(F.substring(t["label"], 1, 2).isin("B-", "I-"), i))
        return let(F.array_compact(inside), opened)

    spans = let(tokens, decode)
    return F.filter(spans, lambda s: s["score"] >= threshold) if scored else spans


def best_label(logits: Column) -> Column:
    """Index of the first maximum."""
    return F.array_position(logits, F.array_max(logits)) - 1


def chosen_probability(logits: Column) -> Column:
    """Softmax probability of the best label."""
    top = F.array_max(logits)
    shift = F.greatest(top, F.lit(0.0))
    return F.exp(top - shift) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - shift))


def pick_models(langs: DataFrame, models: DataFrame, fallback: str) -> DataFrame:
    """Model per language: highest priority, else the first of the fallback language, else the first.

    ``models`` has ``idx, language, priority``.
    """
    best = models.groupBy("language").agg(F.min_by("idx", F.struct(-F.col("priority"), F.col("idx"))).alias("own"))
    rest = models.agg(F.coalesce(F.min(F.when(F.col("language") == fallback, F.col("idx"))), F.lit(0))).scalar()
    return langs.join(best, langs["lang"] == best["language"], "left").select(
        *langs.columns, F.coalesce("own", rest).alias("model_idx"))


def merge_union(hits: DataFrame, key: str = "text_id") -> DataFrame:
    """One hit per exact range, the best scored; of equal scores that of the earlier model (``model_idx``)."""
    return hits.groupBy(key, "st", "en").agg(
        F.max_by("entity", F.struct(F.col("score"), -F.col("model_idx"))).alias("entity"), F.max("score").alias("score"))


MERGED = T.ArrayType(T.StructType([
    T.StructField("st", T.IntegerType()), T.StructField("en", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def greedy(hits: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Hits by score, then start, then end, each kept where it overlaps no kept one; in order of place.

    Kept hits are disjoint and sorted, so only the neighbours of the place where one goes can overlap it.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, float]] = []
    for st, en, score in sorted(hits, key=lambda h: (-h[2], h[0], h[1])):
        at = bisect.bisect_left(starts, st)
        after = at == len(kept) or not (st < kept[at][1] and kept[at][0] < en)
        before = at == 0 or not (st < kept[at - 1][1] and kept[at - 1][0] < en)
        if after and before:
            starts.insert(at, st)
            kept.insert(at, (st, en, score))
    return kept


@F.arrow_udf(MERGED)
def merge_highest(hits: pa.Array) -> pa.Array:
    """Greedy non-overlapping choice from each row's array of hits (``st, en, score``); null gives null."""
    kind = pa.list_(pa.struct([("st", pa.int32()), ("en", pa.int32()), ("score", pa.float64())]))
    return pa.array([None if row is None else [dict(zip(("st", "en", "score"), h)) for h in greedy(
        [(h["st"], h["en"], h["score"]) for h in row])] for row in hits.to_pylist()], kind)


# as with the JSON functions: computed once, not copied into every later expression
merge_highest = merge_highest.asNondeterministic()


def blank_regions(text: Column, spans: Column) -> Column:
    """The text with the spans replaced by as many blanks, so offsets stay valid."""
    def piece(s, i):
        prev = F.when(i > 0, F.element_at(spans, F.greatest(i, F.lit(1)))["en"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, prev + 1, s["st"] - prev), F.repeat(F.lit(" "), s["en"] - s["st"]))

    last = F.element_at(spans, -1)["en"]
    return F.when(F.size(spans) > 0, F.concat(
        F.array_join(F.transform(spans, piece), ""), F.substring(text, last + 1, F.char_length(text)))).otherwise(text)


def widened(text: Column, st: Column, en: Column) -> tuple[Column, Column]:
    """Span grown to whole tokens (letters, digits, ``_ - '``) and clamped to the text."""
    n = F.char_length(text)
    st, en = F.least(st, n), F.least(en, n)
    left = F.regexp_extract(F.substring(text, F.lit(1), st), r"[\p{IsAlphabetic}\p{N}_\-']*\z", 0)
    right = F.regexp_extract(F.substring(text, en + 1, n), r"\A[\p{IsAlphabetic}\p{N}_\-']*", 0)
    return st - F.char_length(left), en + F.char_length(right)


def excluded(value: Column, patterns: tuple[str, ...]) -> Column:
    bare = F.trim(value, F.lit('"'))
    out = F.lit(False)
    for p in patterns:
        out = out | bare.rlike(jvm(p))
    return out


def rule_id(entity: Column, lang: Column) -> Column:
    return F.concat_ws(".", F.lit("ner"), entity, lang)


def category(entity: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ENTITY_CATEGORY.items() for x in kv]), entity)


def degraded_action(action: Column, status: Column, fail_mode: Column, mode: Column) -> Column:
    """A failed model run blocks only when failing closed and enforcing."""
    return F.when((status != "ok") & (fail_mode == "fail_closed") & (mode == "enforce"), "block").otherwise(action)
