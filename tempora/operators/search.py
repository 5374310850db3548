"""Search over names: ranked identities, grouped results, year suggestions, alias links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.functions import scalars as S

ALIAS_COST = 0.25
#: Rows that a group of a search shows.
SECTIONS = {"years": 1, "polities": 6, "places": 4, "rulers": 4}


def ranked(names: DataFrame, aliases: DataFrame, facts: DataFrame, text: str, most: int = 30) -> DataFrame:
    """The best identities for a text: key, score, alias, active, peak, name.

    names and aliases (key, name), facts (key, name, peak, active). An alias counts only where it is strictly better
    after ALIAS_COST, and then its text is returned. An empty text finds nothing. Candidates that no score admits go
    before anything is grouped.
    """
    needle = F.lit(text)
    hit = lambda t: F.struct(t.alias("text"), S.match_score(t, needle).alias("score"))
    hits = F.filter(F.transform(F.array(S.folded(F.col("name"))), hit), lambda h: (h["text"] != "") & h["score"].isNotNull())
    scored = lambda df: df.select("key", F.explode(hits).alias("h")).select("key", "h.text", "h.score").distinct()
    own = scored(names)
    other = scored(aliases).join(own.select("key", "text"), ["key", "text"], "left_anti")
    both = own.select("key", "score", F.lit(None).cast("string").alias("alias")).unionByName(other.select("key", F.col("score") + ALIAS_COST, F.col("text").alias("alias")).toDF("key", "score", "alias"))
    best = both.groupBy("key").agg(F.min(F.struct("score", F.col("alias").isNotNull().alias("by_alias"), "alias")).alias("b"))
    found = best.join(facts, "key").select("key", "b.score", "b.alias", "active", "peak", "name")
    return found.orderBy("score", F.desc("active"), F.desc("peak"), "name", "key").limit(most)


def suggested_year(text: str, lo: int, hi: int, spark) -> DataFrame:
    """The year that a text names, if it lies in lo to hi."""
    return spark.range(1).select(S.parsed_year(F.lit(text)).alias("year")).where(F.col("year").between(lo, hi))


def grouped(parts: dict[str, DataFrame], sections: dict[str, int] = SECTIONS) -> DataFrame:
    """Results (key, name, score, weight) of several searches, each cut to what its section shows: group, rank and these."""
    every = None
    for group, rows in parts.items():
        cut = rows.orderBy("score", F.desc("weight"), "name", "key").limit(sections[group])
        named = cut.select(F.lit(group).alias("group"), "key", "name", "score", "weight")
        every = named if every is None else every.unionByName(named)
    w = Window.partitionBy("group").orderBy("score", F.desc("weight"), "name", "key")
    return every.withColumn("rank", F.row_number().over(w))


def activation(hits: DataFrame, year: int) -> DataFrame:
    """The year that choosing a hit (first, last) leads to: the present one if it is covered, else the nearest bound."""
    return hits.withColumn("goes_to", F.least(F.greatest(F.lit(year), "first"), "last"))


def alias_links(aliases: DataFrame, identities: DataFrame) -> DataFrame:
    """Aliases (canonical, name, ord) by identity (key, name): key and its variants in order, once each, without its own
    name; a canonical that no identity bears has a null key."""
    once = aliases.groupBy("canonical", "name").agg(F.min("ord").alias("ord")).where("name <> canonical")
    listed = once.groupBy("canonical").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("variants"))
    return listed.join(identities.select("key", F.col("name").alias("canonical")), "canonical", "left").select("canonical", "key", "variants")


def unique_links(names: DataFrame, identities: DataFrame) -> DataFrame:
    """Each name with the key of the only identity that bears it; null where none or several do."""
    single = identities.groupBy("name").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where("n = 1")
    return names.join(single.select("name", "key"), "name", "left")
