"""Sizes of the batches that Python workers get where a row holds a whole text."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of an Arrow batch.
TEXT_BATCH, TEXT_BYTES = 512, 16 << 20


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, in rows and in bytes, for the rest of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
