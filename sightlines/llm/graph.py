"""Connected components of an edge table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import kept


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest reachable node, itself included) for every node of edges (a, b).

    Alternates large-star and small-star steps until nothing changes; every step
    is an aggregate and a join on node, written to the shared folder.
    """
    now = kept(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("b").alias("n"), F.col("a").alias("m")).unionByName(now.select(F.col("a").alias("n"), F.col("b").alias("m")))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.filter("m > n").join(low, "n").select(F.col("low").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), "b"), F.struct(F.least("low", "a").alias("a"), F.greatest("low", "a").alias("b")))).alias("e"))
        now = kept(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        s = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.countDistinct("b").alias("d")).first()
        if (s.n, s.h) == mark or not s.n:
            break
        mark = (s.n, s.h)
    roots = now.select(F.col("a").alias("node")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
