"""Evidence: reciprocal checks, source admission, corroboration, samples, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.operators.inorder import in_order

CLAIM = ["person", "polity", "role", "fy", "ty"]


def reciprocal(checks: DataFrame) -> DataFrame:
    """Distinct matched checks whose reverse, with ends swapped, is matched too."""
    matched = checks.where("outcome = 'matched'").select("rid", "src", "arid", "asrc", "person", "polity", "role").distinct()
    back = matched.select(F.col("arid").alias("rid"), F.col("asrc").alias("src"), F.col("rid").alias("arid"), F.col("src").alias("asrc"), "person", "polity", "role")
    return matched.join(back, matched.columns, "left_semi")


def source_review(checks: DataFrame) -> DataFrame:
    """For each source its checked records, those matched, and whether it is admitted: five or more, nine tenths matched."""
    per_record = checks.groupBy("src", "rid").agg(F.bool_or(F.col("outcome") == "matched").alias("hit"))
    counted = per_record.groupBy("src").agg(F.count(F.lit(1)).alias("checked"), F.count_if("hit").alias("matched"))
    return counted.withColumn("admitted", (F.col("checked") >= 5) & (10 * F.col("matched") >= 9 * F.col("checked")))


def claims(assertions: DataFrame) -> DataFrame:
    return assertions.groupBy(*CLAIM).agg(F.count_distinct("lineage").alias("lineages"), F.count_distinct("src").alias("sources"))


def assessed(assertions: DataFrame) -> DataFrame:
    """Claims with a status: disputed where another claim of the person overlaps it with other bounds, else corroborated
    by two lineages or single. Claims differ in their bounds, so a sweep in order of start finds an overlap on either side."""
    order = Window.partitionBy("person", "polity", "role").orderBy("fy", "ty")
    reached = F.max("ty").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rival = F.coalesce(reached >= F.col("fy"), F.lit(False)) | F.coalesce(F.lead("fy").over(order) <= F.col("ty"), F.lit(False))
    status = F.when(F.col("rival"), "disputed").when(F.col("lineages") >= 2, "corroborated").otherwise("single")
    return claims(assertions).withColumn("rival", rival).select(*CLAIM, "lineages", status.alias("status"))


def stratified(rows: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """A sample that takes the first of every stratum, then the second, and so on; orders are by hash."""
    h = F.sha2(F.col(key).cast("string"), 256)
    stratum = F.sha2(F.concat_ws("|", *strata), 256)
    placed = rows.dropDuplicates([key]).withColumn("pos", F.row_number().over(Window.partitionBy(*strata).orderBy(h)))
    return placed.where(F.col("pos") <= n).orderBy("pos", stratum).limit(n).select(key, *strata, "pos")


def nearest_start(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each (key, id, start) of left with the start of right nearest to it in its key; ties stay unresolved.

    Both sides stand in one order by start, so that only the starts around a row are looked at and no pairs are made."""
    starts = right.groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("long")
    line = starts.select("key", F.col("other").alias("at"), F.lit(0).alias("side"), none.alias("id"), F.struct("other", "n").alias("o")).unionByName(
        left.select("key", F.col("start").alias("at"), F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), F.lit(None).cast("struct<other:int,n:bigint>").alias("o"))
    )
    order = Window.partitionBy("key").orderBy("at", "side")
    line = line.withColumns({"below": F.last("o", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "above": F.first("o", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))})
    line = line.where("side = 1 AND (below IS NOT NULL OR above IS NOT NULL)").withColumns({"down": F.col("at") - F.col("below.other"), "up": F.col("above.other") - F.col("at")})
    nearer = F.when(F.col("up").isNull() | (F.col("down") < F.col("up")), F.col("below")).when(F.col("down").isNull() | (F.col("up") < F.col("down")), F.col("above"))
    return line.withColumn("one", nearer).select("key", "id", F.when(F.col("one.n") == 1, F.col("one.other")).alias("other"), F.least("down", "up").alias("gap"))


def merged_places(places: DataFrame) -> DataFrame:
    """Places equal in lower-case name and tenth of a degree are one: the largest value of each year, the first one's name."""
    key = [F.lower("name").alias("key"), F.floor(F.col("lat") * 10 + 0.5).alias("lat10"), F.floor(F.col("lon") * 10 + 0.5).alias("lon10")]
    return places.groupBy(*key, "year").agg(F.max("value").alias("value"), F.min_by("name", "ord").alias("name"))


def lanes(rows: DataFrame, most: int = 4) -> DataFrame:
    """Tenures (key, id, f, t) laid in the first lane that is free by their start; null beyond the last lane.

    Each lane depends on those before it, so a key's tenures are placed in order."""

    def step(ends, f, t):
        free = next((i for i, e in enumerate(ends) if None not in (e, f) and e <= f), None)
        if free is not None:
            ends[free] = t
        elif len(ends) < most:
            free = len(ends)
            ends.append(t)
        return free

    line = rows.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("f").cast("int").alias("f"), F.col("t").cast("int").alias("t"))
    return in_order(line, ["key"], [F.asc_nulls_last(c) for c in ("f", "t", "id")], ["f", "t"], list, step, "lane int")
