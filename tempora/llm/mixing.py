"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue whose documents stand in a seeded shuffled order, repeated in epochs. A document's
virtual finish time is the running total of its source's tokens, itself included, divided by the source's
target; the mix is the documents in order of finish time, cut off at the total budget. Running totals within a source come
from two levels: hash cells get prefix sums, documents only add up within their cell. The order over all sources is a
range sort, whose partitions add up on their own; the mix ends at the last copy whose running total the budget holds.

Targets are weighted filling without a loop: a source is full when filling all others to its own height, its
cap divided by its weight, stays within the budget. Sources are sorted by that height and summed like the copies, so
their number has no bound.

Defined results: a null text has no words and is taken as 0; sources are ordered by code point with null last;
an empty table gives an empty mix. Repeated rows are documents of their own, told apart by a row number; equal finish times
go by a hash of doc_id and text first, so that another split of the input gives the same mix.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tempora.llm.common import drop_scratch, running, width_for, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST_EPOCHS = 2


def targets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """A written table of __key, __source_size and __target from (__key, n), and the budget: SHARE of all sizes.

    All comparisons are between integers: filling to the height cap / weight of a source takes the caps of those no higher
    and weight * height of the others."""
    named = sizes.select("__key", F.col("n").alias("__n"), (F.col("__key") == "n").alias("__last"), F.lit(1).cast("long").alias("__one"))
    placed = running(named, ["__last", "__key"], ["__one"])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("__one_upto") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = written(placed.select("__key", "__n", weight.alias("__w"), (F.lit(MOST_EPOCHS) * F.col("__n")).alias("__cap")), "mix-sources")
    whole, weights = weighed.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__w"), F.lit(0))).first()
    up = running(weighed.withColumn("__height", F.col("__cap") / F.col("__w")), ["__height", "__key"], ["__cap", "__w"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # SHARE.denominator * (caps up to here + height * weights above) <= SHARE.numerator * whole, times this one's weight
    filled = SHARE.denominator * (wide("__cap_upto") * F.col("__w") + wide("__cap") * (F.lit(weights) - F.col("__w_upto")))
    full = filled <= F.lit(SHARE.numerator * whole).cast("decimal(38,0)") * F.col("__w")
    marked = written(up.withColumn("__full", full), "mix-targets")
    taken, free = marked.agg(F.sum(F.when(F.col("__full"), F.col("__cap"))), F.sum(F.when(~F.col("__full"), F.col("__w")))).first()
    unit = (SHARE * whole - (taken or 0)) / free if free else Fraction(0)
    share = F.lit(0.0)
    for w in WEIGHTS:
        share = F.when(F.col("__w") == w, F.lit(float(w * unit))).otherwise(share)
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(share)
    told = written(marked.select("__key", F.col("__n").alias("__source_size"), target.alias("__target")), "mix-told")
    drop_scratch(placed, weighed, up, marked)
    return told, int(SHARE * whole)


def queued(docs: DataFrame, keep: list[str], seed: int = 7) -> tuple[DataFrame, int]:
    """keep, size, source_size, target, at (a hash), row and done (the source's running total before the document, in
    shuffled order), and the total budget in words."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.select(*keep, key.alias("__key"), word_count(F.col("text")).alias("__size"), at.alias("__at"), F.monotonically_increasing_id().alias("__row"))
    # Cells are ranges of the hash, so that their number doesn't change the order.
    cell = F.shiftright((F.shiftright("__at", 40) + (1 << 23)) * F.lit(32 * width_for(docs)).cast("long"), 24).cast("int")
    rows = written(rows.withColumn("__cell", cell), "mix-rows")
    sums = written(rows.groupBy("__key", "__cell").agg(F.sum("__size").alias("__sum")), "mix-sums")
    told, budget = targets(sums.groupBy("__key").agg(F.sum("__sum").alias("n")))
    before = Window.partitionBy("__key").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__key", "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")).join(told, "__key")
    inside = Window.partitionBy("__key", "__cell").orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    line = inner.join(offsets, ["__key", "__cell"]).withColumn("__done", F.col("__before") + F.col("__in"))
    return line.select(*keep, "__size", "__source_size", "__target", "__at", "__row", "__done"), budget


ORDER = ["__finish", "__at", "__row", "__epoch"]


def _finish(epoch):
    return (F.col("__done") + F.col("__size") + epoch * F.col("__source_size")) / F.col("__target")


def _copies(line: DataFrame) -> DataFrame:
    """One row for each copy that the queues can give: epoch, and the virtual time at which it has left its queue."""
    copies = line.where(F.col("__size") > 0).withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))))
    return copies.withColumn("__finish", _finish(F.col("__epoch")))


def cut(line: DataFrame, budget: int) -> Row | None:
    """The last copy of the order over all sources that the budget still holds."""
    ordered = running(_copies(line).select(*ORDER, "__size"), ORDER, ["__size"])
    end = ordered.where(F.col("__size_upto") <= budget).agg(F.max(F.struct(*ORDER))).first()[0]
    drop_scratch(ordered)
    return end


def _held(end: Row | None, epoch, finish):
    """Whether a copy stands in the mix that ends with end."""
    if end is None:
        return F.lit(False)
    upto = F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(ORDER, end, ("double", "long", "long", "int"), strict=True)])
    return F.struct(finish.alias("__finish"), "__at", "__row", epoch.cast("int").alias("__epoch")) <= upto


def schedule(docs: DataFrame, keep: list[str], seed: int = 7) -> DataFrame:
    """The mix itself: a row for each copy, with epoch and finish, in global order of finish time over all partitions."""
    line, budget = queued(docs, keep, seed)
    mixed = _copies(line).where(_held(cut(line, budget), F.col("__epoch"), F.col("__finish")))
    ordered = mixed.repartitionByRange(width_for(docs), *ORDER).sortWithinPartitions(*ORDER)
    return ordered.select(*keep, F.col("__epoch").alias("epoch"), F.col("__finish").alias("finish"))


def mix(docs: DataFrame, keep: list[str], seed: int = 7) -> DataFrame:
    """keep, size, source_size, target and taken, one row for each document."""
    line, budget = queued(docs, keep, seed)
    end = cut(line, budget)
    taken = F.lit(0).cast("long")
    for epoch in range(MOST_EPOCHS):
        held = (F.col("__size") > 0) & _held(end, F.lit(epoch), _finish(F.lit(epoch)))
        taken = taken + F.when(held, F.col("__size")).otherwise(F.lit(0))
    return line.select(*keep, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.alias("taken"))
