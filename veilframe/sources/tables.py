"""Parquet tables and the request, tool-call and audit records derived from them.

Every derivation works row by row, so it scales with its table and adds no shuffle.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str, files: int = 1, size: int | None = None) -> DataFrame:
    """The same table as a stream of its files, some at a time, whether it is one file or a folder of them.

    With ``size``, a micro-batch takes files of about so many bytes, however many they are. Only a pattern may name
    a single file here.
    """
    kind = table(spark, sf_dir, name).schema
    limit = ("maxFilesPerTrigger", files) if size is None else ("maxBytesPerTrigger", size)
    return spark.readStream.schema(kind).option(*limit).parquet(f"{sf_dir}/{name}.parque[t]")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="veilframe-")
    return f"{base.rstrip('/')}/veilframe/{uuid.uuid4().hex}/{name}"


def known_size(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver as a local relation.

    Spark knows its size, so it broadcasts it while that is below the broadcast threshold and joins it
    otherwise. A table of unknown size would sort and shuffle the large side on very few keys.
    """
    kind = T._parse_datatype_string(schema)
    columns = [[row[k] for row in rows] for k in range(len(kind))]
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), kind)


def spread(df: DataFrame, spark: SparkSession, column: str) -> DataFrame:
    """Long texts in few files: deal the rows out so every core has regex work.

    Only where the input has fewer partitions than the cluster has slots; large inputs arrive
    split already and are left alone.
    """
    slots = spark.sparkContext.defaultParallelism
    return df.repartition(slots, column) if df.rdd.getNumPartitions() < slots else df
