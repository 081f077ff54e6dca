"""Documents to training sequences: quality, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import pipeline
from veilframe.llm.pipeline import decontaminate, near_duplicates, pack, private_data, quality  # noqa: F401

STAGES = pipeline.STAGES

#: Fitted rules, hashed shingles and tokens are beyond SQL; ``tests/llm/test_pipeline.py`` holds the stages against plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    return pipeline.run(spark, sf_dir)
