"""What a map and its panels ask for: orders, limits, changes worth showing, places, one identity at one year."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.inorder import in_order
from tempora.operators.temporal import active, area_by_identity, interpolate, lifespans, map_changes, present

#: Ranks of rivers and lakes that show up to a zoom, and how many changes of a kind a list shows.
RANKS = ((1.6, 3, 1), (3.0, 4, 3), (6.0, 5, 5), (math.inf, 6, 6))
SHOWN = {"first": 6, "changed": 5, "gone": 6}
#: A change that stands out, by area or by share of what was.
MAJOR_AREA, MAJOR_SHARE = 50_000, 0.25


def top_of(df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each by, numbered."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)


def snapshot(records: DataFrame, year: int) -> DataFrame:
    """The records of a year, largest first, then by identity."""
    return active(records, year).orderBy(F.desc("a"), "k", "f")


def places(series: DataFrame, year: int, gap: int = 300, after: int = 50) -> DataFrame:
    """T5: keys that show in a year with a figure above 0, largest first: key, value."""
    probes = series.select("key").distinct().withColumn("at", F.lit(year))
    shown = present(series, probes, gap, after).where("shown").select("key")
    return interpolate(series, probes).join(shown, "key").where("value > 0").select("key", "value").orderBy(F.desc("value"), "key")


def by_largest(series: DataFrame) -> DataFrame:
    """Keys by their largest figure."""
    return series.groupBy("key").agg(F.max("value").alias("largest")).orderBy(F.desc("largest"), "key")


def place_index(series: DataFrame) -> DataFrame:
    """Key, first and last year, largest figure."""
    return series.groupBy("key").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.max("value").alias("largest"))


def catalog(records: DataFrame) -> DataFrame:
    """Each identity's name at its peak, its distinct names in order, its span and its peak, the earliest of equals."""
    names = records.groupBy("k").agg(F.array_sort(F.collect_set(F.lower(F.col("n")))).alias("names"), F.max_by("n", F.struct("a", -F.col("f"))).alias("name"))
    return lifespans(records).select("k", "first", "last", "peak_year", "peak_area").join(names, "k")


def is_major(delta: Column, was: Column) -> Column:
    """W6."""
    return (F.abs(delta) >= MAJOR_AREA) | (F.abs(delta) >= was * MAJOR_SHARE)


def areas_between(records: DataFrame, before: int, now: int) -> DataFrame:
    """k, was and seen: the area of each identity mapped in both years, in either null."""
    was, seen = area_by_identity(records, before).withColumnRenamed("area", "was"), area_by_identity(records, now).withColumnRenamed("area", "seen")
    return was.join(seen, "k", "full")


def major_changes(records: DataFrame, before: int, now: int, least: int = 1000) -> DataFrame:
    """Identities whose area changed by at least least and stands out."""
    both = areas_between(records, before, now).where(F.col("was").isNotNull() & F.col("seen").isNotNull()).withColumn("delta", F.col("seen") - F.col("was"))
    return both.where(F.abs("delta") >= least).select("k", "was", "delta", is_major(F.col("delta"), F.col("was")).alias("major"))


def change_list(records: DataFrame, before: int, now: int) -> DataFrame:
    """The first changes of each kind by size: kind, rank, k, delta."""
    changes = map_changes(records, before, now)
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), F.col("kind"))
    ranked = changes.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.abs("delta")), "k")))
    return ranked.where(F.col("rank") <= limit).select("kind", "rank", "k", "delta")


def emphasis(records: DataFrame, before: int, now: int) -> DataFrame:
    """Identities to emphasise: fresh (new), lit (major changes), ghost (gone, and major losses), ghosts by size with the first
    two labelled: role, k, size, labelled."""
    line = areas_between(records, before, now).withColumn("delta", F.coalesce("seen", F.lit(0)) - F.coalesce("was", F.lit(0)))
    both = F.col("was").isNotNull() & F.col("seen").isNotNull() & (F.abs("delta") >= 1000)
    lit = both & is_major(F.col("delta"), F.col("was"))
    roles = F.array_compact(F.array(F.when(F.col("was").isNull(), "fresh"), F.when(lit, "lit"), F.when(F.col("seen").isNull() | (lit & (F.col("delta") < 0)), "ghost")))
    told = line.select("k", F.abs("delta").alias("size"), F.explode(roles).alias("role"))
    ghost = Window.partitionBy("role").orderBy(F.desc("size"), "k")
    return told.select("role", "k", "size", ((F.col("role") == "ghost") & (F.row_number().over(ghost) <= 2)).alias("labelled"))


def in_screen(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """whether a box on the screen reaches into the view."""
    return (x1 >= -margin) & (x0 <= width + margin) & (y1 >= -margin) & (y0 <= height + margin)


def changes_in_view(changes: DataFrame, anchors: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """F8: changes (k) whose anchor (k, x, y) lies in a view; those without an anchor go."""
    seen = anchors.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("k")
    return changes.join(seen, "k", "left_semi")


def rank_limit(zoom: Column, layer: str = "river") -> Column:
    """The highest rank that a layer shows at a zoom."""
    at = 1 if layer == "river" else 2
    out = F.lit(RANKS[-1][at])
    for step in reversed(RANKS[:-1]):
        out = F.when(zoom < step[0], step[at]).otherwise(out)
    return out


def by_rank(features: DataFrame, zoom: float, layer: str = "river") -> DataFrame:
    """features (r) that show at a zoom."""
    return features.where(F.col("r") <= rank_limit(F.lit(float(zoom)), layer))


def label_candidates(boxes: DataFrame, emphasised: DataFrame) -> DataFrame:
    """Boxes (k, x0, y0, x1, y1) in the order in which they claim labels: emphasised (k) first, then by size."""
    marked = boxes.join(emphasised.select("k").distinct().withColumn("lit", F.lit(True)), "k", "left")
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return marked.withColumns({"lit": F.coalesce("lit", F.lit(False)), "size": size}).orderBy(F.desc("lit"), F.desc("size"), "k")


def label_claims(boxes: DataFrame, view: str = "view") -> DataFrame:
    """Greedy labels of each view: boxes (view, ord, x0, y0, x1, y1) in order of ord, each placed unless it meets one that
    was placed before it. Which labels stand depends on the whole order of a view; of a view a task holds the placed ones."""

    def step(held, x0, y0, x1, y1):
        if None in (x0, y0, x1, y1):  # meets nothing
            return True
        for a0, b0, a1, b1 in held:
            if a0 < x1 and a1 > x0 and b0 < y1 and b1 > y0:
                return False
        held.append((x0, y0, x1, y1))
        return True

    return in_order(boxes, [view], ["ord"], ["x0", "y0", "x1", "y1"], list, step, "placed boolean").select(*boxes.columns, "placed")


def window_of(year: Column, scope: Column, lo: int, hi: int) -> Column:
    """struct(lo, hi) of fixed width around a year, held within (lo, hi); scope is a number of years or all."""
    width = F.greatest(F.lit(1), F.least(F.lit(hi - lo), F.coalesce(scope.try_cast("int"), F.lit(100))))
    start = F.greatest(F.lit(lo), F.least(F.lit(hi) - width, F.floor(year - width / 2 + 0.5).cast("int")))
    whole = scope == "all"
    return F.struct(F.when(whole, lo).otherwise(start).alias("lo"), F.when(whole, hi).otherwise(start + width).alias("hi"))


def markers(first: Column, last: Column, peak: Column, year: Column) -> Column:
    """Where peak and year stand on a lifespan, 0 to 1, and whether the year lies in it."""
    span = F.greatest(F.lit(1), last - first)
    at = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - first) / span))
    return F.struct(at(peak).alias("peak"), at(year).alias("now"), year.between(first, last).alias("shown"))


def anchors(records: DataFrame, points: list[str], year: int) -> DataFrame:
    """The point of the largest record of each identity in a year, the earliest of equals."""
    best = active(records, year).groupBy("k").agg(F.max_by(F.struct(*points), F.struct("a", -F.col("f"))).alias("p"))
    return best.select("k", *[F.col(f"p.{c}").alias(c) for c in points])


def next_change(years: DataFrame, year: int, lo: int, hi: int, back: bool = False) -> DataFrame:
    """The change year after a year (or before it) within a lifespan; no row means none."""
    held = years.where(F.col("year").between(lo, hi) & ((F.col("year") < year) if back else (F.col("year") > year)))
    return held.agg((F.max if back else F.min)("year").alias("year")).where("year IS NOT NULL")


def summary(records: DataFrame, year: int) -> DataFrame:
    """For every identity its area in a year, its share of its peak, its span, and how it stands: mapped, between (absent
    inside its span), before or after."""
    spans = lifespans(records).select("k", "first", "last", "peak_year", "peak_area")
    line = spans.join(area_by_identity(records, year), "k", "left")
    stands = F.when(F.col("area").isNotNull(), "mapped").when(F.col("first") > year, "before").when(F.col("last") < year, "after").otherwise("between")
    return line.withColumns({"status": stands, "share": F.coalesce(F.col("area") / F.col("peak_area"), F.lit(0.0))})


def slider_year(position: Column, scope: Column, lo: Column, hi: Column, to_year) -> Column:
    """The year under a slider from 0 to 1: in a narrow scope a single year, never 0; over all of history what to_year gives,
    which is then taken to the nearest change year."""
    single = F.floor(lo + position * (hi - lo) + 0.5).cast("int")
    return F.when(scope == "all", F.floor(to_year(position) + 0.5).cast("int")).otherwise(F.when(single == 0, 1).otherwise(single))


def entered_year(parsed: Column, lo: int = -3400, hi: int = 2024) -> Column:
    """A year that was typed, if it lies in the range; null leaves the view as it is."""
    return F.when(parsed.between(lo, hi), parsed)


def holders(roster: DataFrame) -> DataFrame:
    """For each polity the names of its active holders, or else of those possibly in office, in order."""
    names = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("name"))))
    per = roster.groupBy("polity").agg(names("active").alias("on"), names("possibly_active").alias("maybe"))
    return per.select("polity", F.when(F.size("on") > 0, F.col("on")).otherwise(F.col("maybe")).alias("names"), (F.size("on") > 0).alias("certain"))
