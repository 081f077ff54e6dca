"""Thin queries over the given tables, one per operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (balance, blocks, collocations, decontam, embeddings, manifest, minhash, packing, pii, recurrent,
                           rules, toxicity, warc)
from veilframe.llm.common import crc_mod, table
from veilframe.llm.oracle import ORACLES  # noqa: F401


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _joined(hits: str) -> str:
    return f"array_join(transform({hits}, h -> concat(h.kind, ':', h.st, ':', h.en)), ',')"


def private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.private_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(hits, h -> h.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.expr(f"sha2({_joined('hits')}, 256)").alias("base_sha256"),
                        F.expr(_joined("array_sort(concat(hits, terms))")).alias("spans"))


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages")).filter("kind in ('response', 'revisit')")
    page = "nullif(regexp_extract({}, '^<urn:page:(-?[0-9]*)>$', 1), '')"
    return read.select(F.expr(page.format("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                       F.col("kind").alias("record_type"),
                       F.expr(page.format("refers_to")).cast("long").alias("refers_to"))


def packing_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def _held_out(mod: int, rest: int):
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(False))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _held_out(7, 2)
    return recurrent.fit_and_score(docs, ~held).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return blocks.main_text(pages, blocks.fit_labeller(pages))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = _held_out(4, 2)
    model = rules.fit_quality(docs, labels.filter(~held))
    return rules.with_quality(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = _held_out(5, 0)
    model = toxicity.fit_toxicity(docs, labels.filter(~held))
    return toxicity.toxicity(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "largest_gain", "windows")


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def packing_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.pack_balanced(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_private_data": private_data,
    "op2_warc_salvage": warc_salvage,
    "op3_recurrent_language_model": language_model,
    "op4_block_labeller": page_text,
    "op5_best_fit_packing": packing_best_fit,
    "op6_quality_rules": quality,
    "op7_minhash_near_duplicates": near_documents,
    "op8_benchmark_leaks": benchmark_leaks,
    "op9_toxicity": toxic_text,
    "op10_near_vectors": near_vectors,
    "op11_merkle_manifest": merkle_manifest,
    "op12_phrase_collocations": phrase_collocations,
    "op13_cost_balanced_packing": packing_balanced,
}
