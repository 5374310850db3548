"""Checks of published tables as queries: every check is a row (check, found, wanted, fine), or the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.operators.temporal import active


def row(df: DataFrame, check: str, found: Column, lo, hi=None) -> DataFrame:
    """One check: an aggregate that has to lie in lo to hi, or to be lo."""
    hi = lo if hi is None else hi
    value = found.cast("double")
    return df.agg(value.alias("found")).select(F.lit(check).alias("check"), "found", F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.coalesce(F.col("found").between(float(lo), float(hi)), F.lit(False)).alias("fine"))


def all_of(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def arbitrated(records: DataFrame, renamed: list[str], before: int) -> DataFrame:
    """V2: no wrapper in parentheses is left, and no old name of a renamed record before a year."""
    early = F.col("n").isin(renamed) & (F.col("f") < before) if renamed else F.lit(False)
    return all_of([row(records, "wrappers", F.count_if(F.col("n").startswith("(")), 0), row(records, "old names", F.count_if(early), 0)])


def preceded(records: DataFrame, windows: list[tuple[str, int, int]], prefix: str) -> DataFrame:
    """V3: exactly the declared windows (name, f, t) are of tier 1, and their sources carry a prefix."""
    top = records.where("tier = 1")
    wanted = records.sparkSession.createDataFrame(windows, "n string, f int, t int")
    return all_of([
        row(top, "tier 1", F.count(F.lit(1)), len(windows)),
        row(top.join(wanted, ["n", "f", "t"], "left_anti"), "undeclared", F.count(F.lit(1)), 0),
        row(wanted.join(top, ["n", "f", "t"], "left_anti"), "missing", F.count(F.lit(1)), 0),
        row(top, "foreign sources", F.count_if(~F.col("s").startswith(prefix)), 0),
    ])


def misplaced_labels(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """V4: names and years (n, year, bx0, by0, bx1, by1) whose largest record's anchor (x, y) of that year lies outside the box, or
    that have no record then."""
    met = wanted.alias("w").join(records.alias("r"), (F.col("w.n") == F.col("r.n")) & (F.col("r.f") <= F.col("w.year")) & (F.col("r.t") >= F.col("w.year")), "left")
    best = met.groupBy("w.n", "w.year", "w.bx0", "w.by0", "w.bx1", "w.by1").agg(F.max_by(F.struct("r.x", "r.y"), F.struct("r.a", -F.col("r.f"))).alias("p"))
    inside = F.col("p.x").between(F.col("bx0"), F.col("bx1")) & F.col("p.y").between(F.col("by0"), F.col("by1"))
    return best.where(~F.coalesce(inside, F.lit(False))).select("n", "year", "p.x", "p.y")


def wrong_facts(index: DataFrame, facts: DataFrame) -> DataFrame:
    """V5: facts (name, what, lo, hi) that the index (name and numbers) does not bear out; what names a column of the index."""
    columns = [c for c in index.columns if c != "name"]
    values = index.select("name", F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select("name", "v.*")
    met = facts.join(values, ["name", "what"], "left")
    return met.where(~F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False))).select("name", "what", "value")


def lacking(index: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """V5: wanted (name, member) that the array column of the index (name) does not hold."""
    met = wanted.join(index.select("name", column), "name", "left")
    return met.where(~F.coalesce(F.array_contains(F.col(column), F.col("member")), F.lit(False))).select("name", "member")


def series_checks(series: DataFrame, points: int, lo: float, hi: float) -> DataFrame:
    """V6: as many points as there should be, one for each year, the last one in a range."""
    return all_of([
        row(series, "points", F.count(F.lit(1)), points), row(series, "repeated years", F.count(F.lit(1)) - F.count_distinct("year"), 0), row(series, "last", F.max_by("value", "year"), lo, hi),
    ])


def agreement_checks(agreements: DataFrame, least: list[tuple[int, float]]) -> DataFrame:
    """V7: the best agreement (year, iou) of each year reaches what is asked."""
    return all_of([row(agreements.where(F.col("year") == year), f"iou {year}", F.max("iou"), lo, 1.0) for year, lo in least])


def layer_checks(layer: DataFrame, least: int, most: int, ranks: int = 6) -> DataFrame:
    """V8: how many features a layer has, and that their ranks are 0 to ranks."""
    return all_of([row(layer, "features", F.count(F.lit(1)), least, most), row(layer, "odd ranks", F.count_if(F.col("r").isNull() | ~F.col("r").between(0, ranks)), 0)])


def raster_checks(cells: DataFrame, count: int, lo: float, hi: float) -> DataFrame:
    """As many cells as there should be, their median in a range."""
    return all_of([row(cells, "cells", F.count(F.lit(1)), count), row(cells, "median", F.median("value"), lo, hi)])


def headline(records: DataFrame, told: DataFrame, year: int) -> DataFrame:
    """V9: counts that a document tells (what, told) against those of the data: records, identities, and identities mapped in a year."""
    now = active(records, year)
    counted = records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("k").alias("identities")).crossJoin(F.broadcast(now.agg(F.count_distinct("k").alias("mapped"))))
    real = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("real")) for c in ("records", "identities", "mapped")])).alias("v")).select("v.*")
    return told.join(real, "what", "left").select("what", "told", "real", F.coalesce(F.col("told") == F.col("real"), F.lit(False)).alias("fine"))
