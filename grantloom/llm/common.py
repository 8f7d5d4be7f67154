"""Helpers shared by the text operators: tables, shared scratch folders and bounded Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from grantloom.session import checkpoint_ready

#: Rows per Arrow batch: texts are long, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of a batch that goes to Python, so that long texts fit into a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that all executors share."""
    checkpoint_ready(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later passes and lost executors don't redo them."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def text_chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text (one longer text stands alone); null is empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
