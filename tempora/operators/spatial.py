"""Operators on half-open integer rectangles, joined by grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.temporal import active, lifespans
from tempora.operators.tiles import CELL, nearest_names, smallest_holding


def cells(df: DataFrame) -> DataFrame:
    cx = F.sequence(F.floor(F.col("x0") / CELL), F.floor((F.col("x1") - 1) / CELL))
    cy = F.sequence(F.floor(F.col("y0") / CELL), F.floor((F.col("y1") - 1) / CELL))
    return df.withColumn("cx", F.explode(cx)).withColumn("cy", F.explode(cy))


def overlap(a: str, b: str) -> Column:
    side = lambda c: F.greatest(F.lit(0), F.least(F.col(f"{a}.{c}1"), F.col(f"{b}.{c}1")) - F.greatest(F.col(f"{a}.{c}0"), F.col(f"{b}.{c}0")))
    return side("x") * side("y")


def meeting(left: DataFrame, right: DataFrame, on: list[str] = ()) -> DataFrame:
    """Pairs of rectangles that overlap and are equal in columns on, as a and b, from the first cell they share."""
    a, b = cells(left).alias("a"), cells(right).alias("b")
    first = lambda c: F.greatest(F.floor(F.col(f"a.{c}0") / CELL), F.floor(F.col(f"b.{c}0") / CELL)) == F.col(f"a.c{c}")
    found = first("x") & first("y") & (overlap("a", "b") > 0)
    for c in ["cx", "cy", *on]:
        found = found & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, found)


def tier_overlaps(boxes: DataFrame, year: int) -> DataFrame:
    now = active(boxes, year)
    return meeting(now.where("tier = 1"), now.where("tier = 2")).select(F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), overlap("a", "b").alias("shared"))


def iou(boxes: DataFrame, year: int) -> DataFrame:
    now = active(boxes, year)
    size = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    shared = overlap("a", "b")
    return meeting(now.where("tier = 1"), now.where("tier = 2")).select(F.col("a.k").alias("k1"), F.col("b.k").alias("k2"), (shared / (size("a") + size("b") - shared)).alias("iou"))


def containing(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each point (id, x, y) the smallest rectangle that holds it, the smaller k of equals."""
    return smallest_holding(points, boxes)


def successors(boxes: DataFrame, floor: float = 0.03, top: int = 6, back: bool = False) -> DataFrame:
    """For each identity those that lie on its peak rectangle the year after its last (or before its first), by share of the peak."""
    spans = lifespans(boxes).select("k", "first", "last", "peak_year")
    peaks = boxes.join(spans, "k").where("f = peak_year")
    edge = F.col("first") - 1 if back else F.col("last") + 1
    whole = spans.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    subject = peaks.crossJoin(F.broadcast(whole)).where("first > lo" if back else "last < hi").withColumn("edge", edge)
    best = nearest_names(subject.select("k", "edge", "x0", "y0", "x1", "y1"), boxes.select("k", "n", "f", "t", "x0", "y0", "x1", "y1"), floor, top)
    return best.select("k", "rank", "name", F.round(F.col("share") * 100, 1).alias("pct"))


def thinned(points: DataFrame, cell: int, budget: int) -> DataFrame:
    """The heaviest point of each cell, up to a budget."""
    w = Window.partitionBy(F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(F.desc("weight"), "id")
    return points.withColumn("r", F.row_number().over(w)).where("r = 1").orderBy(F.desc("weight"), "id").limit(budget).select("id", "x", "y", "weight")
