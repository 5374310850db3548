"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges so that every node comes to point at smaller ones: the large star links a node's larger
neighbours to its smallest, the small star its smaller ones. Rounds go on until none changes an edge; they are written
tables, so that lineage stays short; edges and labels never leave the executors. A round has no more rows than two for each edge.
An empty table gives no labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, written


def components(edges: DataFrame) -> DataFrame:
    """A written table of node and component, its smallest connected node, for the nodes of edges (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    seen = mark = None
    while mark is None or mark != seen and mark[0]:
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        following = written(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
        drop_scratch(now)
        now = following
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    labels = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(labels.select("node"), "node", "left_anti")
    named = written(labels.unionByName(roots.select("node", F.col("node").alias("component"))), "labels")
    drop_scratch(now)
    return named
