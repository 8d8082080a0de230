"""Connected components by alternating star operations, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.scratch import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: longs) that is not the smallest of its component.

    Each round links larger neighbours, then smaller ones, to the smallest neighbour, until every component is a
    star (Kiveris et al., Connected Components in MapReduce and Beyond). A round joins edges with one number per
    node, so that a node with very many edges can be split over tasks.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.save(edges)
    n = edges.count()
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n)
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Kept by the executors within a round, so that either side of a join can be split; a round's result is written.
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).persist()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().persist()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).persist()
        joined = large.join(lower, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v")))
        after = scratch.save(small.distinct(), n)
        for frame in (lower, large, least):
            frame.unpersist()
        scratch.drop(now)
        now = after
