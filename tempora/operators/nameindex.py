"""A stored index of names by the short runs of characters in them, so that a search reads the postings of one run.

A name can only match a text if it holds, for each word of the text, the word or (of six letters and more) its stem; so it holds every
run of up to three characters of these. The index keeps each distinct folded name with each of its runs of one to three characters,
in folders by a hash of the run, sorted by run, and how many names hold a run. A search takes the rarest run of what its text asks
for, reads the names of that run alone (one folder, and of its files the parts with that run) and scores them as without an index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.functions import scalars as S
from tempora.operators import search

LONGEST_RUN, FOLDERS = 3, 64


def runs_of(text: Column) -> Column:
    """The distinct runs of one to three characters of a text without spaces in them."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    every = F.concat(*[F.when(F.length(text) >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in range(1, LONGEST_RUN + 1)])
    return F.array_distinct(F.filter(every, lambda g: ~g.contains(" ")))


def asked(words: list[str]) -> set[str]:
    """The longest runs that every match of the words holds."""
    found = set()
    for w in words:
        sure = w[: max(5, len(w) - 2)] if len(w) >= 6 else w
        n = min(LONGEST_RUN, len(sure))
        found |= {sure[i : i + n] for i in range(len(sure) - n + 1)}
    return found


def _folder(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(FOLDERS)).cast("int")


def build(names: DataFrame, aliases: DataFrame, path: str) -> None:
    """Stores the index of names and aliases (key, name). An alias that is also a name of its key counts as a name."""
    own = names.select("key", S.folded(F.col("name")).alias("text")).where("text <> ''").distinct()
    other = aliases.select("key", S.folded(F.col("name")).alias("text")).where("text <> ''").distinct().join(own, ["key", "text"], "left_anti")
    both = own.withColumn("by_alias", F.lit(False)).unionByName(other.withColumn("by_alias", F.lit(True)))
    rows = both.withColumn("run", F.explode(runs_of(F.col("text")))).withColumn("folder", _folder(F.col("run")))
    # A run that most names hold is spread over several tasks of its folder by the name.
    dealt = rows.repartition(F.col("folder"), F.pmod(F.xxhash64("key", "text"), F.lit(8))).sortWithinPartitions("folder", "run")
    dealt.write.partitionBy("folder").parquet(f"{path}/postings")
    counts = names.sparkSession.read.parquet(f"{path}/postings").groupBy("run").agg(F.count(F.lit(1)).alias("names"))
    counts.withColumn("folder", _folder(F.col("run"))).repartition(1, "folder").sortWithinPartitions("folder", "run").write.partitionBy("folder").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """key, text and by_alias of all names that may match a text; None where it asks for nothing or for a run that no name holds."""
    folded, *_ = spark.range(1).select(S.folded(F.lit(text))).first()
    runs = sorted(asked(folded.split()))
    if not runs:
        return None
    places = [r[0] for r in spark.createDataFrame([(r,) for r in runs], "run string").select(_folder(F.col("run"))).distinct().collect()]
    counts = spark.read.parquet(f"{path}/counts").where(F.col("folder").isin(places) & F.col("run").isin(runs))
    held = {r.run: (r.names, r.folder) for r in counts.collect()}
    if len(held) < len(runs):
        return None
    rarest = min(runs, key=lambda r: (held[r][0], r))
    found = spark.read.parquet(f"{path}/postings").where((F.col("folder") == held[rarest][1]) & (F.col("run") == rarest))
    return found.select("key", "text", "by_alias")


def ranked(spark: SparkSession, path: str, facts: DataFrame, text: str, most: int = 30) -> DataFrame:
    """Q1: what search.ranked() gives, from the index."""
    found = candidates(spark, path, text)
    if found is None:
        found = spark.read.parquet(f"{path}/postings").select("key", "text", "by_alias").where("false")
    pick = lambda alias: found.where(F.col("by_alias") == alias).select("key", F.col("text").alias("name"))
    return search.ranked(pick(False), pick(True), facts, text, most)


def ruler_names(claims: DataFrame) -> DataFrame:
    """Q4: the names of accepted claims (claim, name, aliases) as key and name: their own and each alias."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return claims.select(F.col("claim").alias("key"), F.explode(every).alias("name")).where("name IS NOT NULL")


def rulers(spark: SparkSession, path: str, claims: DataFrame, text: str) -> DataFrame:
    """Q4: claims (claim, from and others) by the best score of any of their names, then by their start, unknown ones last."""
    found = candidates(spark, path, text)
    if found is None:
        return claims.withColumn("score", F.lit(0.0)).where("false")
    best = found.withColumn("score", S.match_score(F.col("text"), F.lit(text))).where("score IS NOT NULL").groupBy(F.col("key").alias("claim")).agg(F.min("score").alias("score"))
    return claims.join(best, "claim").orderBy("score", F.col("from").asc_nulls_last(), "claim")
