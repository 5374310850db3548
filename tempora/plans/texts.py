"""Queries of source adapters and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import dates
from tempora.plans.catalog import ASR, query
from tempora.sources import adapters, derived


@query("s11_unpivoted", "SELECT c_custkey, CAST(-100 AS INTEGER) AS year, c_acctbal AS value FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 50, CAST(c_nationkey AS DOUBLE) FROM customer WHERE c_nationkey > 0")
def _(s, d):
    wide = derived.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("BC_100"), F.col("c_nationkey").alias("AD_50"))
    return adapters.unpivoted(wide, ["c_custkey"])


@query("s19_table_rows")
def _(s, d):
    return adapters.table_rows(derived.table(s, d, "pages"), "page_id", "html")


@query("s22_links")
def _(s, d):
    return adapters.links(derived.table(s, d, "pages"), "page_id", "html")


@query("s34_stale", "SELECT o_orderkey, side FROM orders, (VALUES ('built'), ('published')) v(side) WHERE o_orderkey % 7 = CASE side WHEN 'built' THEN 0 ELSE 1 END")
def _(s, d):
    o = derived.table(s, d, "orders").select("o_orderkey")
    return adapters.stale(o.where("o_orderkey % 7 <> 1"), o.where("o_orderkey % 7 <> 0"))


@query("p24_date_ranges", f"WITH {ASR} SELECT DISTINCT fy, ty, fy AS first, ty AS last, 'year' AS precision FROM asr")
def _(s, d):
    years = derived.assertions(s, d).select("fy", "ty").distinct()
    found = years.withColumn("r", dates.date_range(F.concat(F.lit("3 May "), "fy", F.lit(" – "), "ty", F.lit(" (aged 9)"))))
    return found.select("fy", "ty", F.col("r.from").alias("first"), F.col("r.to").alias("last"), "r.precision")


@query("p34_record_ids", "SELECT l_orderkey, l_linenumber, l_partkey, left(sha256(concat(l_orderkey, '|', l_linenumber, '|', l_partkey)), 20) AS id FROM lineitem")
def _(s, d):
    key = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]
    return derived.table(s, d, "lineitem").select(*key, dates.record_id(*[c.cast("string") for c in key]).alias("id"))


@query("p37_city_radius", "SELECT c_custkey, round(greatest(1.6, least(3.1, 1.2 + 0.75 * log10((c_custkey + 1) * 700 / 5000))), 9) AS radius FROM customer")
def _(s, d):
    return derived.table(s, d, "customer").select("c_custkey", F.round(dates.city_radius((F.col("c_custkey") + 1) * 700), 9).alias("radius"))
