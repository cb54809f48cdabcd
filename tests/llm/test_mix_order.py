"""The fill of a mix reads the whole order of a source."""

import random

from sightlines.llm import mixing


def test_mix_fills_from_the_whole_order(spark, monkeypatch):
    """Nothing that is left fits in what is left of a source's target, and bounds of the bins change nothing."""
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.choice([1, 2, 3, 40, 200, 900]), "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    whole = sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "SMALL", 5)
    got = mixing.mix(df).collect()
    gap = {r.source: r.target for r in got}
    for r in got:
        gap[r.source] -= r.taken
    assert not [r for r in got if r.wanted % 1 > 1e-9 and r.taken_copies == int(r.wanted) and r.size <= gap[r.source]]
    assert sorted((r.doc_id, r.taken) for r in got) == whole


def test_few_documents_are_tried_behind_the_cut(spark, monkeypatch):
    """One source of 60,000 documents of many sizes: the walk behind the bin that holds the cut sees under one in a hundred."""
    from pyspark.sql import functions as F

    seen, plain = [], mixing.first_fits

    def counted(rows):
        tried, untried = plain(rows)
        seen.append((tried.count(), rows.count()))
        return tried, untried

    monkeypatch.setattr(mixing, "first_fits", counted)
    monkeypatch.setattr(mixing, "SMALL", 500)
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert all(0 <= r.target - r.taken < 2 for r in got) and sum(r.n for r in got) == 60_000
    assert seen and seen[0][0] < 600


def test_sample_bounds_at_any_size():
    from sightlines.llm.session import hash_bound

    for n in (1, 2_000, 10**6, 3 * 10**9, 10**15, 10**30):
        share = (hash_bound(n, 2_000) + (1 << 63)) / (1 << 64)
        assert 0 < share <= 1 and (n < 10**4 or n > 10**15 or abs(share * n - 2_000) < 1)
