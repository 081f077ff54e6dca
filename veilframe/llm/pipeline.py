"""Stages from documents to training sequences: quality, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontam, minhash, packing, pii, rules
from veilframe.llm.common import drop_staged, free_name, staged, table
from veilframe.llm.queries import tokenizer_path

#: Parts that the rows of one component are dealt to before they meet its first row.
SHARES = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on all labels, scores at 0.7 or more; all of them without labels.

    Null and empty texts are scored like others. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    if labels.filter("quality is not null and doc_id is not null").isEmpty():
        return docs
    model, score = rules.fit_quality(docs, labels), free_name(docs, "score")
    return rules.with_quality(docs, model, score=score).filter(F.col(score) >= 0.7).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose sets of five-word shingles overlap by 0.8 or more: one with the smallest id.

    The rows are numbered once in a table of the shared folder and told apart by number, so null and
    repeated ids are grouped like others; of equal ids the first numbered row stays. A text without
    words is in no group. An empty table stays empty. Groups are decided on numbers alone: texts move
    for the search of candidates and once more to leave out the rows that go.
    """
    row = free_name(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered, size=5, percent=80, key=row).filter("n_shingles > 0").select(
        F.col("doc_id").alias("row"), "component_id")
    found = staged(found, "found")
    shared = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select(
        "component_id", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    grouped = staged(found.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(SHARES)).cast("int")).join(
        shared, ["component_id", "share"]).join(numbered.select(F.col(row).alias("row"), "doc_id"), "row"), "grouped")
    firsts = grouped.groupBy("component_id", "share").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("low"))
    firsts = firsts.groupBy("component_id").agg(F.min("low")["row"].alias("row"))
    goes = staged(grouped.select("row").join(firsts.select("row"), "row", "left_anti").withColumnRenamed("row", row), "goes")
    return numbered.join(goes, row, "left_anti").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark segment in them; null and empty texts stay, an empty table stays empty."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms replaced; ``n_chars`` follows the text.

    A null text stays null and has no number of characters. An empty table stays empty.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 2048 tokens as best fit needs; an empty table has none."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("private_data", private_data), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    A stage's table is deleted when the next one is written; the last one's input stays, since its rows
    are read when the result is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_staged(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
