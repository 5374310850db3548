"""Arbitration rules over records, identity keys, and the sources that answer for a year.

A rule's scope constrains only by the keys that it has; all rules see the record as it came, so they commute but for the last
rename or retime, and any suppression drops the record. Rules are a reviewed list: more than MOST_RULES are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.functions import scalars as S

MOST_RULES = 1000


def in_scope(rule: dict) -> Column:
    """Whether a record (source, name, type, components, from_year) is in a rule's scope; a missing from_year counts as 0."""
    year = F.coalesce(F.col("from_year"), F.lit(0))
    found = F.lit(True)
    for key in ("source", "name", "type"):
        if key in rule:
            found = found & F.col(key).eqNullSafe(F.lit(rule[key]))
    if "has_components" in rule:
        found = found & ((F.trim(F.coalesce("components", F.lit(""))) != "") == F.lit(rule["has_components"]))
    if "from_year_in" in rule:
        found = found & F.coalesce(F.col("from_year").isin(*rule["from_year_in"]), F.lit(False))
    if "years" in rule:
        found = found & year.between(*rule["years"])
    return found


def apply_rules(records: DataFrame, rules: list[dict]) -> DataFrame:
    """Records that no rule suppresses, with name, wikidata, f and t as the last rename and retime say, protected, and arb: ids of rules that held."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules = [r for r in rules if r.get("status", "active") == "active"]
    hit = {i: in_scope(r) for i, r in enumerate(rules)}
    of = lambda action: [i for i, r in enumerate(rules) if r["action"] == action]
    last = lambda action, key, old: F.coalesce(*[F.when(hit[i], F.lit(rules[i][key])) for i in reversed(of(action)) if key in rules[i]], F.col(old))
    any_of = lambda action: F.exists(F.array(F.lit(False), *[hit[i] for i in of(action)]), lambda x: x)
    arb = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(hit[i], F.lit(r["id"])) for i, r in enumerate(rules) if r["action"] != "suppress"]))
    changed = {"name": last("rename", "to_name", "name"), "wikidata": last("rename", "to_wikidata", "wikidata"), "f": last("retime", "to_f", "f"), "t": last("retime", "to_t", "t")}
    return records.where(~any_of("suppress")).withColumns(changed | {"protected": any_of("protect_from_clip"), "arb": arb})


def ambiguous_ids(records: DataFrame) -> DataFrame:
    """External ids under which more than one normalised name goes; wrappers in parentheses do not count."""
    named = records.where(F.col("wikidata").isNotNull() & ~F.col("name").startswith("("))
    return named.groupBy("wikidata").agg(F.count_distinct(S.name_key(F.col("name"))).alias("names")).where("names > 1")


def identity_keys(records: DataFrame) -> DataFrame:
    """Adds key: the external id unless it is ambiguous, else the normalised name."""
    doubtful = ambiguous_ids(records).select("wikidata", F.lit(True).alias("__doubtful"))
    joined = records.join(doubtful, "wikidata", "left")
    own = F.col("wikidata").isNotNull() & F.col("__doubtful").isNull()
    return joined.withColumn("key", F.when(own, F.concat(F.lit("wd:"), "wikidata")).otherwise(F.concat(F.lit("nm:"), S.name_key(F.col("name"))))).drop("__doubtful")


def only_in_one(left: DataFrame, right: DataFrame, most: int = 25) -> DataFrame:
    """Names that only one of two sides has, compared normalised: side and name, the first `most` of each by name."""
    found = []
    for side, a, b in (("left", left, right), ("right", right, left)):
        keyed = a.select("name", S.name_key(F.col("name")).alias("key")).join(b.select(S.name_key(F.col("name")).alias("key")).distinct(), "key", "left_anti")
        found.append(keyed.select("name").distinct().orderBy("name").limit(most).select(F.lit(side).alias("side"), "name"))
    return found[0].unionByName(found[1])


def active_sources(registry: DataFrame, year: int, tiers: list[int]) -> DataFrame:
    """Sources of the tiers whose window covers the year; no window means always, no role means extent."""
    window = F.coalesce("lo", F.lit(-1_000_000_000)) <= year, F.coalesce("hi", F.lit(1_000_000_000)) >= year
    return registry.where(F.col("tier").isin(*tiers) & window[0] & window[1] & F.coalesce(F.col("role") == "extent", F.lit(True)))


def nearest_snapshot(snapshots: DataFrame, year: int, tolerance: int = 150) -> DataFrame:
    """The rows of the snapshot (year, ord) nearest to a year, none beyond the tolerance; the earlier listed of equals."""
    years = snapshots.groupBy("year").agg(F.min("ord").alias("ord")).where(F.abs(F.col("year") - year) <= tolerance)
    best = years.agg(F.min_by("year", F.struct(F.abs(F.col("year") - year), "ord")).alias("year"))
    return snapshots.join(F.broadcast(best), "year", "left_semi")  # one row
