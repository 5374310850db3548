"""Operators on closed intervals, change points and irregular series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(records: DataFrame, year: int | Column) -> DataFrame:
    """As-of filter: records whose closed interval holds the year."""
    return records.where((F.col("f") <= year) & (F.col("t") >= year))


def change_years(records: DataFrame) -> DataFrame:
    """Distinct years at which some record starts or has just ended."""
    return records.select(F.explode(F.array("f", F.col("t") + 1)).alias("year")).distinct()


def nearest(probes: DataFrame, years: DataFrame) -> DataFrame:
    """For each probe the nearest change year, the earlier of two equally near, with its neighbours.

    Probes and years are merged in one order by ranges of RANGE years, so that a range needs only the last year
    before it and the first after it, which come from per-range extremes."""
    cell = F.floor(F.col("year") / RANGE)
    ranges = years.groupBy(cell.alias("cell")).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    cells = ranges.select("cell", "lo", "hi").unionByName(probes.select(cell.alias("cell"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))).groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = Window.orderBy("cell")
    around = cells.select("cell", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.min("lo").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    inside = years.groupBy(cell.alias("cell")).agg(F.collect_list("year").alias("years"))
    joined = probes.withColumn("cell", cell).join(around, "cell").join(inside, "cell", "left")
    y, near = F.col("year"), F.coalesce("years", F.array().cast("array<int>"))
    upto = F.coalesce(F.array_max(F.filter(near, lambda x: x <= y)), F.col("below"))
    after = F.coalesce(F.array_min(F.filter(near, lambda x: x > y)), F.col("above"))
    pick = F.when(upto.isNull(), after).when(after.isNull() | (y - upto <= after - y), upto).otherwise(after)
    return joined.select("year", upto.alias("at_or_before"), after.alias("after"), pick.alias("nearest"))


#: Years to a range in nearest(); a range holds at most so many distinct change years.
RANGE = 512


def in_force(years: DataFrame) -> DataFrame:
    """Each change year with the one before it: within a range of RANGE years by a window, across ranges by their extremes, of
    which there are few."""
    cell = F.floor(F.col("year") / RANGE)
    cells = years.groupBy(cell.alias("cell")).agg(F.max("year").alias("hi"))
    below = cells.select("cell", F.lag("hi").over(Window.orderBy("cell")).alias("below"))
    inside = years.withColumn("cell", cell).withColumn("previous", F.lag("year").over(Window.partitionBy("cell").orderBy("year")))
    return inside.join(below, "cell").select("year", F.coalesce("previous", "below").alias("previous"))


def bracketed(series: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (key, at) with the figure at or before them (y0, v0) and the one after (y1, v1), from one order of both."""
    figure = F.struct(F.col("year").alias("y"), F.col("value").cast("double").alias("v"))
    none = F.lit(None).cast("struct<y:int,v:double>")
    line = series.select("key", F.col("year").cast("double").alias("pos"), F.lit(0).alias("side"), F.lit(None).cast("int").alias("at"), figure.alias("p"))
    line = line.unionByName(probes.select("key", F.col("at").cast("double").alias("pos"), F.lit(1).alias("side"), F.col("at").cast("int").alias("at"), none.alias("p")))
    order = Window.partitionBy("key").orderBy("pos", "side")
    before = F.last("p", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    met = line.withColumns({"b": before, "a": after}).where("side = 1")
    return met.select("key", "at", F.col("b.y").alias("y0"), F.col("b.v").alias("v0"), F.col("a.y").alias("y1"), F.col("a.v").alias("v1"))


def interpolate(series: DataFrame, probes: DataFrame) -> DataFrame:
    """Values at probes (key, at): held at the ends, exact where given, log-linear where both ends are positive, else linear."""
    share = (F.col("at") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    v0, v1 = F.col("v0"), F.col("v1")
    between = F.when((v0 > 0) & (v1 > 0), F.exp(F.log(v0) + (F.log(v1) - F.log(v0)) * share)).otherwise(v0 + (v1 - v0) * share)
    value = F.when(F.col("y0").isNull(), v1).when(F.col("y1").isNull() | (F.col("y0") == F.col("at")), v0).otherwise(between)
    return bracketed(series, probes).where("y0 IS NOT NULL OR y1 IS NOT NULL").select("key", "at", value.alias("value"))


def present(series: DataFrame, probes: DataFrame, gap: int = 300, after: int = 50) -> DataFrame:
    """Whether a key shows at a probe: from its first figure to after years past its last, but not inside gaps longer than gap."""
    at, y0, y1 = F.col("at"), F.col("y0"), F.col("y1")
    shown = F.when(at == y0, True).when(y0.isNull(), False).when(y1.isNull(), at <= y0 + after).otherwise(y1 - y0 <= gap)
    return bracketed(series, probes).select("key", "at", shown.alias("shown"))


def area_by_identity(records: DataFrame, year: int | Column) -> DataFrame:
    return active(records, year).groupBy("k").agg(F.sum("a").alias("area"))


def map_changes(records: DataFrame, before: int, now: int, least: int = 1000) -> DataFrame:
    """Identities that are new (first or back), gone (with their return and last year) or changed by at least least."""
    was, seen = area_by_identity(records, before).withColumnRenamed("area", "was"), area_by_identity(records, now).withColumnRenamed("area", "is")
    joined = was.join(seen, "k", "full")
    kind = F.when(F.col("was").isNull(), "first").when(F.col("is").isNull(), "gone").when(F.abs(F.col("is") - F.col("was")) >= least, "changed")
    life = records.groupBy("k").agg(F.min(F.when(F.col("f") > now, F.col("f"))).alias("back"), F.max(F.when(F.col("t") < now, F.col("t"))).alias("last"))
    gone = F.col("kind") == "gone"
    return joined.withColumn("kind", kind).where("kind IS NOT NULL").join(life, "k").select(
        "k", "kind", (F.coalesce("is", F.lit(0)) - F.coalesce("was", F.lit(0))).alias("delta"), F.when(gone, F.col("back")).alias("returns"), F.when(gone, F.col("last")).alias("last_mapped")
    )


def lifespans(records: DataFrame) -> DataFrame:
    """First and last year, and the peak: largest area, the earliest of equals."""
    peak = F.max_by(F.struct("f", "n"), F.struct(F.col("a"), -F.col("f")))
    spans = records.groupBy("k").agg(F.min("f").alias("first"), F.max("t").alias("last"), F.max("a").alias("peak_area"), peak.alias("p"))
    return spans.select("k", "first", "last", "peak_area", F.col("p.f").alias("peak_year"), F.col("p.n").alias("name"))


def edge_flags(spans: DataFrame) -> DataFrame:
    """Whether a lifespan touches the span of all."""
    whole = spans.agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    return spans.crossJoin(F.broadcast(whole)).select("k", (F.col("first") <= F.col("lo")).alias("tstart"), (F.col("last") >= F.col("hi")).alias("tend"))


def extent_steps(records: DataFrame) -> DataFrame:
    """Total area of each identity from each of its change years on: deltas at starts and after ends, summed up."""
    deltas = records.select("k", F.explode(F.array(F.struct(F.col("f").alias("year"), F.col("a").alias("d")), F.struct((F.col("t") + 1).alias("year"), (-F.col("a")).alias("d")))).alias("e"))
    by_year = deltas.groupBy("k", "e.year").agg(F.sum("e.d").alias("d"))
    return by_year.select("k", "year", F.sum("d").over(Window.partitionBy("k").orderBy("year")).alias("area"))


def density(records: DataFrame, lo: int, hi: int, bins: int) -> DataFrame:
    """Starts and ends by bin of (lo, hi]; bins without any count 0."""
    years = records.select(F.explode(F.array("f", F.col("t") + 1)).alias("y")).where((F.col("y") > lo) & (F.col("y") <= hi))
    at = F.floor((F.col("y") - lo) * bins / F.lit(hi - lo)).cast("int")
    counted = years.where(F.col("y") < hi).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def top_per_key(records: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("a"), "f"))
    return records.withColumn("rank", rank).where(F.col("rank") <= n).select("k", "rank", "f", "a")


def home_ground(records: DataFrame, share: float = 0.01) -> DataFrame:
    """The smallest record of at least a share of the identity's peak, the earliest of equals."""
    peak = F.max("a").over(Window.partitionBy("k"))
    large = records.withColumn("peak", peak).where(F.col("a") >= F.col("peak") * share)
    return large.groupBy("k").agg(F.min(F.struct("a", "f")).alias("m")).select("k", F.col("m.f").alias("f"), F.col("m.a").alias("a"))


def split_at(records: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Records cut at the edges of disjoint windows: the parts before, inside and after each that they cross."""
    edges = sorted({e for lo, hi in windows for e in (lo, hi + 1)})
    cuts = F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: (e > F.col("f")) & (e <= F.col("t")))
    starts = F.concat(F.array("f"), cuts)
    parts = F.arrays_zip(starts.alias("f0"), F.concat(F.transform(cuts, lambda e: e - 1), F.array("t")).alias("t0"))
    inside = F.lit(False)
    for lo, hi in windows:
        inside = inside | ((F.col("p.f0") >= lo) & (F.col("p.f0") <= hi))
    return records.withColumn("p", F.explode(parts)).select("k", "a", "tier", F.col("p.f0").alias("f"), F.col("p.t0").alias("t"), inside.alias("inside"))


def superseded(records: DataFrame, year: int) -> DataFrame:
    """Records of a year: tier 1, and of the others those that share no key (k or name) with a tier-1 record."""
    now = active(records, year)
    keys = now.withColumn("key", F.explode(F.array(F.concat(F.lit("k:"), F.col("k")), F.concat(F.lit("n:"), F.col("n")))))
    ruled = keys.where("tier <> 1").join(keys.where("tier = 1").select("key").distinct(), "key", "left_semi").select("k", "f").distinct()
    return now.where("tier = 1").unionByName(now.where("tier <> 1").join(ruled, ["k", "f"], "left_anti"))


def interval_overlaps(left: DataFrame, right: DataFrame, cell: int = 512, on: list[str] | None = None) -> DataFrame:
    """Pairs whose closed intervals overlap and whose columns on are equal, by equal cells of years; a pair comes from its first common cell."""
    cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("f") / cell), F.floor(F.col("t") / cell))))
    a, b = cells(left).alias("a"), cells(right).alias("b")
    first = F.greatest(F.floor(F.col("a.f") / cell), F.floor(F.col("b.f") / cell))
    same = F.lit(True)
    for c in on or []:
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.f") <= F.col("b.t")) & (F.col("b.f") <= F.col("a.t")) & (F.col("a.cell") == first))


def overlap_counts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """rows of left with overlaps: how many closed intervals of right with equal columns on overlap theirs; those without any go.

    What overlaps has begun by the row's end and not ended before its start: both are running totals by year, so that no pairs are made."""
    zero, one = F.lit(0), F.lit(1)
    entry = lambda df, at, begun, ended: df.select(*on, at.alias("at"), begun.alias("begun"), ended.alias("ended"))
    solid = right.where("f <= t")
    asked = left.where("f <= t")
    every = entry(solid, F.col("f"), one, zero).unionByName(entry(solid, F.col("t") + 1, zero, one)).unionByName(entry(asked, F.col("t"), zero, zero)).unionByName(entry(asked, F.col("f"), zero, zero))
    years = every.groupBy(*on, "at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    so_far = Window.partitionBy(*on).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    totals = years.select(*on, "at", F.sum("begun").over(so_far).alias("begun"), F.sum("ended").over(so_far).alias("ended"))
    line = asked.join(totals.select(*on, F.col("at").alias("t"), "begun"), [*on, "t"]).join(totals.select(*on, F.col("at").alias("f"), "ended"), [*on, "f"])
    return line.withColumn("overlaps", F.col("begun") - F.col("ended")).where("overlaps > 0").select(*left.columns, "overlaps")
