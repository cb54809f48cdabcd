"""What the operators need from the session: tables, the shared folder, batch sizes."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch where a row holds a whole text.
TEXT_BATCH, TEXT_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small, in rows and in bytes, for the rest of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it (Spark ignores case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Two 64-bit hashes that know a row by its columns; nulls and empty values differ."""
    cols = [x for c in columns or df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return [F.xxhash64(F.lit(seed), *cols) for seed in (1, 2)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where none is set, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 100_000) -> bool:
    """Whether df has so few rows that it may be sent to all executors."""
    return df.limit(most + 1).count() <= most


def hash_bound(n: int, most: int) -> int:
    """The signed 64-bit bound below which about `most` of n hashes lie; at any n at least one in 2^64 does."""
    return -(1 << 63) + min((1 << 64) - 1, max(1, (most << 64) // max(n, 1)))


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
