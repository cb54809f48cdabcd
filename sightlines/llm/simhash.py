"""Document fingerprints: 64-bit SimHash and its search by permuted block tables.

Terms are three-word shingles of the lower-cased (A-Z) words, words being runs
of anything but ASCII white space; a shorter text is one term.  A term weighs
as often as it occurs, and each occurrence votes on all 64 bits with the signed bits of its
hash.  A bit is set where more than half the votes are for it.

Defined cases: null and blank texts have fingerprint 0; equal texts have equal
fingerprints; texts of any length are taken whole; tables may be empty and may
have other columns.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import kept
from .textkit import WordTable, shingle_hashes, word_hashes

BITS, TERM_WORDS, VOTES_AT_ONCE = 64, 3, 1 << 17
_WORDS = WordTable()


def fingerprints(texts: pa.Array) -> np.ndarray:
    """uint64 fingerprint of every text of an Arrow string column."""
    terms, off = shingle_hashes(*word_hashes(texts, _WORDS), TERM_WORDS)
    n = len(off) - 1
    ones = np.zeros((n, BITS), np.int64)
    doc = np.repeat(np.arange(n), np.diff(off))
    for at in range(0, len(terms), VOTES_AT_ONCE):
        part, of = terms[at : at + VOTES_AT_ONCE], doc[at : at + VOTES_AT_ONCE]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        firsts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ones[of[firsts]] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
    set_ = 2 * ones > np.diff(off)[:, None]
    return np.packbits(set_, axis=1).view(">u8").ravel().astype(np.uint64) if n else np.empty(0, np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- near search


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Bit masks of the permuted tables.

    The 64 bits are cut into blocks; at most `radius` of them can hold a
    differing bit, so each choice of the other blocks is a table, and two
    fingerprints within the radius agree on all bits of one mask at least.
    """
    blocks = blocks or radius + 3
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(cuts)]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _tables(fps: DataFrame, name: str, radius: int) -> DataFrame:
    fp: Column = F.col(name)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(block_masks(radius))])
    return fps.withColumn("key", F.explode(keys))


def near(queries: DataFrame, all_: DataFrame, radius: int = 3) -> DataFrame:
    """query_fp, fp, distance for every pair of different fingerprints within radius.

    Both sides are made distinct first, so copies cost nothing; the caller joins members back by fp.
    Both grow with the input, so they are merged and neither passes through the driver.
    """
    q = _tables(queries.select(F.col("fp").alias("query_fp")).distinct(), "query_fp", radius)
    a = _tables(all_.select("fp").distinct(), "fp", radius)
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp"))).alias("distance")
    return q.join(a.hint("merge"), "key").select("query_fp", "fp", distance).filter((F.col("distance") <= radius) & (F.col("query_fp") != F.col("fp"))).distinct()


def near_documents(docs: DataFrame, queries: Column, radius: int = 3) -> DataFrame:
    """doc_id, fp, n_equal, n_near, near_fps for the documents that `queries` selects, against all."""
    fps = kept(fingerprint_table(docs), "simhash")
    asked = fps.filter(queries)
    members = fps.groupBy("fp").agg(F.count("*").alias("members"))
    pairs = near(asked, members, radius).join(members.hint("merge"), "fp").groupBy("query_fp").agg(
        F.sum("members").alias("n_near"), F.array_sort(F.collect_list("fp")).alias("near_fps")
    )
    return (
        asked.join(members.hint("merge"), "fp")
        .join(pairs.hint("merge"), F.col("fp") == F.col("query_fp"), "left")
        .select("doc_id", "fp", (F.col("members") - 1).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("near_fps", F.expr("array()").cast("array<bigint>")).alias("near_fps"))
    )


# ------------------------------------------------------- texts and their edits

EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket: its documents in order, then the next bucket's first one (halo)."""
    kept = None  # the last row read: (bucket, doc_id, text)
    for b in batches:
        rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()))
        ids, texts, nexts = [], [], []
        for bucket, halo, doc_id, text in rows:
            if kept is not None and kept[0] == bucket:
                ids.append(kept[1])
                texts.append(kept[2])
                nexts.append(text or "")
            kept = None if halo else (bucket, doc_id, text or "")
        if not ids:
            continue
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]
        # a row's next is mostly the next row: fingerprint that text once
        chain = texts + [n for i, n in enumerate(nexts) if i + 1 == len(nexts) or texts[i + 1] is not n]
        fp_all = fingerprints(pa.array(chain, pa.string()))
        own, spare, after = fp_all[: len(texts)], iter(fp_all[len(texts) :]), np.empty(len(texts), np.uint64)
        for i, n in enumerate(nexts):
            after[i] = next(spare) if i + 1 == len(nexts) or texts[i + 1] is not n else own[i + 1]
        fe = fingerprints(pa.array(edited, pa.string()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array([f"{x:016x}" for x in own.tolist()]),
                pa.array([f"{x:016x}" for x in fe.tolist()]),
                pa.array(likeness(own, fe)),
                pa.array(likeness(own, after)),
            ],
            [c.split()[0] for c in EDITED.split(", ")],
        )


def _bucket(bounds: list[int], key: Column) -> Column:
    """How many bounds are at most key, by binary search; null: 0."""
    if not bounds:
        return F.lit(0).cast("long")
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    step = lambda at, s: at + F.when((at + s <= len(bounds)) & (F.element_at(table, F.least(at + s, F.lit(len(bounds))).cast("int")) <= key), s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s).cast("long") for s in steps]), F.lit(0).cast("long"), step)


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last floor(n/2) code points are the first ones of the next document.

    The next document is the next row by doc_id (null first), then text; after
    the last comes the first.  Rows are dealt to buckets of doc_id ranges; the
    first row of each is also sent to the bucket before, so one shuffle of the
    texts is enough and no task sees more than its range, in a stream.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("c")).first().c
    bounds = sorted(set(cuts or []))
    placed = rows.withColumn("bucket", _bucket(bounds, F.col("doc_id")))
    firsts = sorted((r.bucket, r.first) for r in placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id"))).alias("f")).select("bucket", F.col("f.doc_id").alias("first")).collect())
    before = spark.createDataFrame([(b, f, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)], "b long, f long, prev long")  # a row for each bucket
    both = placed.join(F.broadcast(before), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("f")), "left").select(
        F.explode(
            F.filter(
                F.array(F.struct("bucket", F.lit(0).alias("halo")), F.struct(F.col("prev").alias("bucket"), F.lit(1).alias("halo"))),
                lambda x: x["bucket"].isNotNull(),
            )
        ).alias("at"),
        "doc_id",
        "text",
    )
    dealt = both.select("at.bucket", "at.halo", "doc_id", "text").repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(_edit, EDITED)
