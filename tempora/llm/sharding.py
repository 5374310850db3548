"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group and stay together. Groups go, largest first, to the least loaded shard
through a heap. Groups of equal size are alike, so the heap runs over size classes (size, count), of which
there are at most sqrt(2 * total bytes), and not over groups; each class gets a run-length plan that says how
many of its groups each shard takes. Groups find their place in the plan by their rank in the class, and rows
by their rank in the shard; both ranks come from two levels of counts, so that no class, group or shard
gathers in one task.

Defined results: a null text counts as empty and shares a group with empty texts; repeated rows are rows of
their own; an empty table gives no rows. The law is "bytes": loads differ by at most the largest group.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.llm.common import shuffle_width, written

SHARDS = 8


def lpt_plan(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, from_rank, to_rank, shard) runs for classes of (group size, groups); to_rank is exclusive.

    A class with many groups is laid in whole rounds first: as long as every shard would take one more group
    before any takes two (their loads differ by no more than the size), a round adds one group to each.
    """
    heap = [(0, s) for s in range(shards)]
    runs: list[tuple[int, int, int, int]] = []
    for size, left in sorted(classes, reverse=True):
        took = [0] * shards
        while left:
            low, high = heap[0][0], max(heap)[0]
            rounds = left // shards if high - low <= size else 0
            if rounds > 1:
                rounds -= 1
                heap = [(load + rounds * size, s) for load, s in heap]
                took = [t + rounds for t in took]
                left -= rounds * shards
            else:
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                took[s] += 1
                left -= 1
        at = 0
        for s, n in enumerate(took):
            if n:
                runs.append((size, at, at + n, s))
                at += n
    return runs


def ranked(df: DataFrame, by: list[str], order: list[str], spread, out: str) -> DataFrame:
    """Adds out: a gapless rank from 0 within by. spread is a column that cuts each by into small cells."""
    cells = df.withColumn("__cell", spread)
    counts = cells.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__cell").orderBy(*order)
    numbered = cells.withColumn("__in", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*by, "__cell"]).withColumn(out, (F.col("__before") + F.col("__in")).cast("long")).drop("__cell", "__in", "__n", "__before")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")
    )
    rows = written(rows, "shard-rows")
    cells = 4 * shuffle_width(spark)
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("bytes").count().collect()]
    plan = spark.createDataFrame(lpt_plan(classes, shards), "bytes long, lo long, hi long, shard int")
    by_rank = ranked(groups, ["bytes"], ["key"], F.pmod(F.xxhash64("key"), F.lit(cells)), "rank")
    placed = by_rank.join(plan, ["bytes"]).where("rank >= lo AND rank < hi").select("key", "shard")
    dealt = written(rows.join(placed, "key").select("doc_id", "size", "text_crc32", "shard"), "shard-dealt")
    numbered = ranked(dealt, ["shard"], ["doc_id", "text_crc32"], F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(16 * shuffle_width(spark))), "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
