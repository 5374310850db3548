"""Queries of consolidation, office groups and routes over all claims of the derived sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import consolidation
from tempora.plans.catalog import query
from tempora.plans.identities import OPEN, ROWS, claim_rows, open_rows


@query("a23_consolidated")
def _(s, d):
    """People of an office are one by id or by a name that sources share; neighbours share names, and every third has an external id."""
    person = F.col("person")
    known = F.concat(F.when(person % 3 == 0, "wd:").otherwise("n"), person)
    name = F.concat(F.lit("name "), F.floor((person + F.when(F.col("src").isin("s0", "s1"), 1).otherwise(0)) / 2))
    rows = claim_rows(s, d).select("id", F.concat_ws("/", "polity", "role").alias("block"), known.alias("person"), F.col("src").alias("source"), name.alias("name"))
    return consolidation.consolidated(rows)


@query(
    "a24_office_merges",
    f"""WITH {ROWS}, g AS (SELECT *, CASE src WHEN 's0' THEN 'Monarch' WHEN 's4' THEN 'Monarch' WHEN 's3' THEN 'Duke' ELSE 'King' END AS office FROM claim),
 o AS (SELECT *, arg_min(office, id) FILTER (WHERE office <> 'Monarch') OVER (PARTITION BY polity, person, "from", "to") AS named FROM g),
 r AS (SELECT *, CASE WHEN office = 'Monarch' THEN coalesce(named, office) ELSE office END AS clique FROM o)
 SELECT polity, person, "from", "to", string_agg(id, ',' ORDER BY id) AS ids FROM r GROUP BY polity, person, "from", "to", clique HAVING count(*) > 1""",
)
def _(s, d):
    """Monarchs go with the first named office of their tenure; kings and dukes stay apart."""
    office = F.when(F.col("src").isin("s0", "s4"), "Monarch").when(F.col("src") == "s3", "Duke").otherwise("King")
    found = consolidation.merges(claim_rows(s, d).withColumn("role", office).select("id", "polity", "person", "from", "to", "role"))
    return found.select("polity", "person", "from", "to", F.array_join("ids", ",").alias("ids"))


@query(
    "e14_routed",
    f"""WITH {OPEN}, n AS (SELECT *, polity || '/' || person || '/' || role AS component FROM part_known WHERE src IN ('s1', 's4')), x AS (SELECT id AS peer, polity, person, role, "from" AS f, "to" AS t, src FROM claim WHERE src IN ('s2', 's3') AND person % 4 = 0),
 j AS (SELECT n.id, n.component, n.person, n."from", n."to", n.src, count(x.peer) AS peers, coalesce(bool_or(x.f <> n."from" OR x.t <> n."to"), false) AS against, coalesce(bool_or(x.f = n."from" AND x.t IS NOT DISTINCT FROM n."to"), false) AS there,
  coalesce(bool_or(x.f = n."from" AND x.t IS NOT DISTINCT FROM n."to" AND x.src = 's2'), false) AS same FROM n LEFT JOIN x USING (polity, person, role) GROUP BY ALL),
 a AS (SELECT *, CASE WHEN "from" < 1993 THEN 'rejected' WHEN "to" IS NULL AND peers > 0 THEN 'candidateDuplicate' WHEN against THEN 'conflict' WHEN same THEN 'matched' WHEN there THEN 'duplicate' WHEN person % 7 = 0 THEN 'candidateDuplicate' ELSE 'import' END AS route FROM j),
 l AS (SELECT * FROM a WHERE route = 'import'), b AS (SELECT DISTINCT component, "from", "to" FROM l WHERE "to" IS NOT NULL),
 c AS (SELECT DISTINCT p.component, p."from", p."to" FROM b p JOIN b q ON p.component = q.component AND (p."from" <> q."from" OR p."to" <> q."to") AND (p."from" = q."from" OR greatest(p."from", q."from") < least(p."to", q."to"))),
 e AS (SELECT l.id, CASE WHEN l."to" IS NULL AND l.component IN (SELECT component FROM b) THEN 'candidateDuplicate' WHEN c.component IS NOT NULL THEN 'conflict'
  WHEN l."to" IS NOT NULL AND l.id > min(l.id) OVER (PARTITION BY l.component, l."from", l."to") THEN 'duplicate' ELSE l.route END AS again FROM l LEFT JOIN c ON c.component = l.component AND c."from" = l."from" AND c."to" = l."to")
 SELECT id, coalesce(again, route) AS route FROM a LEFT JOIN e USING (id)""",
)
def _(s, d):
    same = ["polity", "person", "role"]
    rows = open_rows(s, d).where("src IN ('s1', 's4')")
    known = claim_rows(s, d).where("src IN ('s2', 's3') AND person % 4 = 0").select(*same, F.col("id").alias("peer"), F.col("from").alias("f"), F.col("to").alias("t"), F.when(F.col("src") == "s2", "year").otherwise("day").alias("precision"))
    peers = rows.select("id", *same).join(known, same).select("id", "peer", F.col("f").alias("from"), F.col("t").alias("to"), "precision")
    new = rows.select("id", F.concat_ws("/", *same).alias("component"), (F.col("from") >= 1993).alias("valid"), F.lit("year").alias("precision"), "from", "to", (F.col("person") % 7 == 0).alias("ambiguous"), F.lit(False).alias("external"))
    return consolidation.routed(new, peers).select("id", "route")
