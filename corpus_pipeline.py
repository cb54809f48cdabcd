"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with
all their columns; the last adds how often the mix takes each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightlines.llm import decontaminate, jaccard, mixing, pii, quality
from sightlines.llm.session import kept, table, text_batches


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    text_batches(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more."""
    text_batches(spark)
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    text_batches(spark)
    return decontaminate.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    text_batches(spark)
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with mix_copies, the times it takes each."""
    return mixing.drawn(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
]

#: Models, links and an order sample are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
