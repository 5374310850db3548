"""Queries of rules, search and identity operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tempora.operators import identity, nameindex, rules, search
from tempora.plans.catalog import ASR, query
from tempora.sources import derived
from tempora.sources.stores import shared_dir

RULES = [
    {"id": "r1", "action": "rename", "source": "BUILDING", "years": [0, 4], "to_name": "Builders", "to_wikidata": "Q1"},
    {"id": "r2", "action": "suppress", "source": "MACHINERY", "from_year_in": [7, 9]},
    {"id": "r3", "action": "retime", "type": "debt", "to_f": -5},
    {"id": "r4", "action": "protect_from_clip", "has_components": True},
    {"id": "r5", "action": "suppress", "name": "Customer#000000003", "status": "draft"},
]
RECORDS = "rec AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS source, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS type, CASE WHEN c_custkey % 3 = 0 THEN 'a;b' ELSE ' ' END AS components, c_nationkey AS from_year, CAST(NULL AS VARCHAR) AS wikidata, CAST(0 AS INTEGER) AS f, CAST(9 AS INTEGER) AS t FROM customer)"
ROWS = ASR + ', claim AS (SELECT rid AS id, min(src) AS src, min(lineage) AS lineage, min(polity) AS polity, min(person) AS person, min(role) AS role, min(fy) AS "from", min(ty) AS "to" FROM asr GROUP BY rid)'
OPEN = ROWS + """, part_known AS (SELECT * REPLACE (CASE WHEN hash_digit = 0 THEN NULL ELSE "to" END AS "to") FROM (SELECT *, ascii(left(id, 1)) % 4 AS hash_digit FROM claim))"""


def records(s, d):
    c = derived.table(s, d, "customer")
    none = F.lit(None).cast("string")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("source"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("type"),
        F.when(F.col("c_custkey") % 3 == 0, "a;b").otherwise(" ").alias("components"), F.col("c_nationkey").alias("from_year"), none.alias("wikidata"), F.lit(0).alias("f"), F.lit(9).alias("t"),
    )


def claim_rows(s, d):
    took = {"src": "src", "lineage": "lineage", "polity": "polity", "person": "person", "role": "role", "fy": "from", "ty": "to"}
    return derived.assertions(s, d).groupBy(F.col("rid").alias("id")).agg(*[F.min(a).alias(b) for a, b in took.items()])


def open_rows(s, d):
    return claim_rows(s, d).withColumn("to", F.when(F.ascii(F.left("id", F.lit(1))) % 4 == 0, None).otherwise(F.col("to")))


@query(
    "p1_rules",
    f"""WITH {RECORDS}, h AS (SELECT *, source = 'BUILDING' AND from_year BETWEEN 0 AND 4 AS r1, type = 'debt' AS r3, trim(components) <> '' AS r4 FROM rec WHERE NOT (source = 'MACHINERY' AND from_year IN (7, 9)))
 SELECT id, CASE WHEN r1 THEN 'Builders' ELSE name END AS name, CASE WHEN r1 THEN 'Q1' END AS wikidata, CAST(CASE WHEN r3 THEN -5 ELSE f END AS INTEGER) AS f, t, r4 AS protected,
 concat_ws(',', CASE WHEN r1 THEN 'r1' END, CASE WHEN r3 THEN 'r3' END, CASE WHEN r4 THEN 'r4' END) AS arb FROM h""",
)
def _(s, d):
    return rules.apply_rules(records(s, d), RULES).select("id", "name", "wikidata", "f", "t", "protected", F.array_join("arb", ",").alias("arb"))


NAMED = "named AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN concat(p_brand, '-', p_size) END AS wikidata, CASE WHEN p_size % 7 = 0 THEN concat('(', p_name, ')') ELSE p_name END AS name FROM part)"
DOUBTFUL = NAMED + ", doubt AS (SELECT wikidata, count(DISTINCT regexp_replace(lower(name), '[^a-z]', '', 'g')) AS names FROM named WHERE wikidata IS NOT NULL AND name NOT LIKE '(%' GROUP BY 1 HAVING names > 1)"


def named(s, d):
    p = derived.table(s, d, "part")
    wd = F.when(F.col("p_size") % 5 > 0, F.concat_ws("-", "p_brand", "p_size"))
    return p.select(F.col("p_partkey").alias("id"), wd.alias("wikidata"), F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("("), "p_name", F.lit(")"))).otherwise(F.col("p_name")).alias("name"))


@query("a1_ambiguous_ids", f"WITH {DOUBTFUL} SELECT wikidata, names FROM doubt")
def _(s, d):
    return rules.ambiguous_ids(named(s, d))


@query("p2_identity_keys", f"WITH {DOUBTFUL} SELECT id, CASE WHEN wikidata IS NOT NULL AND wikidata NOT IN (SELECT wikidata FROM doubt) THEN concat('wd:', wikidata) ELSE concat('nm:', regexp_replace(lower(name), '[^a-z]', '', 'g')) END AS key FROM named")
def _(s, d):
    return rules.identity_keys(named(s, d)).select("id", "key")


@query(
    "j8_only_in_one",
    """WITH l AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name < 'red'), r AS (SELECT DISTINCT upper(p_name) AS name FROM part WHERE p_name > 'hot'),
 a AS (SELECT name FROM l WHERE regexp_replace(lower(name), '[^a-z]', '', 'g') NOT IN (SELECT regexp_replace(lower(name), '[^a-z]', '', 'g') FROM r) ORDER BY name LIMIT 25),
 b AS (SELECT name FROM r WHERE regexp_replace(lower(name), '[^a-z]', '', 'g') NOT IN (SELECT regexp_replace(lower(name), '[^a-z]', '', 'g') FROM l) ORDER BY name LIMIT 25)
 SELECT 'left' AS side, name FROM a UNION ALL SELECT 'right', name FROM b""",
)
def _(s, d):
    p = derived.table(s, d, "part")
    return rules.only_in_one(p.where("p_name < 'red'").select(F.col("p_name").alias("name")), p.where("p_name > 'hot'").select(F.upper("p_name").alias("name")))


@query("s10_active_sources", "SELECT s_suppkey, CAST(s_suppkey % 3 + 1 AS INTEGER) AS tier FROM supplier WHERE s_suppkey % 3 < 2 AND s_nationkey * 10 - 150 <= 0 AND (s_suppkey % 4 = 0 OR s_nationkey * 10 >= 40)")
def _(s, d):
    hi = F.when(F.col("s_suppkey") % 4 == 0, None).otherwise(F.col("s_nationkey") * 10 - 40)
    registry = derived.table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3 + 1).cast("int").alias("tier"), (F.col("s_nationkey") * 10 - 150).alias("lo"), hi.alias("hi"), F.lit(None).cast("string").alias("role"))
    return rules.active_sources(registry, 0, [1, 2]).select("s_suppkey", "tier")


@query("s8_nearest_snapshot", "WITH y AS (SELECT s_suppkey, s_nationkey * 40 - 500 AS year, s_suppkey AS ord FROM supplier) SELECT s_suppkey, CAST(year AS INTEGER) AS year FROM y WHERE year = (SELECT year FROM y WHERE abs(year - 10) <= 150 ORDER BY abs(year - 10), ord LIMIT 1)")
def _(s, d):
    y = derived.table(s, d, "supplier").select("s_suppkey", (F.col("s_nationkey") * 40 - 500).alias("year"), F.col("s_suppkey").alias("ord"))
    return rules.nearest_snapshot(y, 10).select("s_suppkey", "year")


def score_sql(text: str) -> str:
    return f"CASE WHEN {text} = 'red bolt' THEN 0.0 WHEN starts_with({text}, 'red bolt') THEN 1.0 WHEN contains({text}, 'red bolt') THEN 2.0 WHEN contains({text}, 'red') AND contains({text}, 'bolt') THEN 3.0 END"


SEARCH = f"""own AS (SELECT DISTINCT p_partkey AS key, trim(regexp_replace(lower(concat(p_type, ' ', p_name)), '[^a-z0-9]+', ' ', 'g')) AS text FROM part),
 other AS (SELECT DISTINCT p_partkey AS key, trim(regexp_replace(lower(concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' ' || p_size ELSE '' END)), '[^a-z0-9]+', ' ', 'g')) AS text FROM part WHERE p_size > 10),
 s AS (SELECT key, CAST({score_sql('text')} AS DOUBLE) AS score, NULL AS alias FROM own UNION ALL SELECT key, {score_sql('text')} + 0.25, text FROM other),
 b AS (SELECT key, score, alias, row_number() OVER (PARTITION BY key ORDER BY score, alias IS NOT NULL, alias) AS nth FROM s WHERE score IS NOT NULL),
 hits AS (SELECT key, score, alias, p_size > 25 AS active, p_retailprice AS peak, p_name AS name FROM b JOIN part ON p_partkey = key WHERE nth = 1 ORDER BY score, active DESC, peak DESC, name, key LIMIT 30)"""


def searched(s, d):
    """Names, aliases and facts of parts."""
    p = derived.table(s, d, "part")
    own = p.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    other = p.where("p_size > 10").select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))).alias("name"))
    facts = p.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("peak"), (F.col("p_size") > 25).alias("active"))
    return own, other, facts


def hits(s, d):
    return search.ranked(*searched(s, d), "red bolt")


@query("q1_search", f"WITH {SEARCH} SELECT * FROM hits")
def _(s, d):
    return hits(s, d)


def index_path(s):
    return f"{shared_dir(s)}/tempora/names-{uuid.uuid4().hex}"


@query("q1_indexed_search", f"WITH {SEARCH} SELECT * FROM hits")
def _(s, d):
    """The same from a stored index."""
    own, other, facts = searched(s, d)
    nameindex.build(own, other, path := index_path(s))
    return nameindex.ranked(s, path, facts, "red bolt")


@query(
    "q4_ruler_search",
    """WITH n AS (SELECT p_partkey AS claim, unnest([p_name, p_type || ' ' || p_name, p_brand]) AS name FROM part), f AS (SELECT claim, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS t FROM n)
 SELECT claim, CAST(p_size AS INTEGER) AS "from", CAST(min(CASE WHEN contains(t, 'economix widgetoo') THEN 2 WHEN contains(t, 'economix') AND contains(t, 'widgetoo') THEN 3 ELSE 3.5 END) AS DOUBLE) AS score
 FROM f JOIN part ON p_partkey = claim WHERE contains(t, 'econom') AND contains(t, 'widget') GROUP BY ALL""",
)
def _(s, d):
    """Claims with a name and two aliases each; what matches holds the stems of both words."""
    claims = derived.table(s, d, "part").select(F.col("p_partkey").alias("claim"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", "p_name"), F.col("p_brand")).alias("aliases"), F.col("p_size").cast("int").alias("from"))
    names = nameindex.ruler_names(claims)
    nameindex.build(names, names.where("false"), path := index_path(s))
    return nameindex.rulers(s, path, claims.select("claim", "from"), "Economix widgetoo").select("claim", "from", "score")


@query(
    "q2_grouped_search",
    f"""WITH {SEARCH}, places AS (SELECT s_suppkey AS key, s_name AS name, CAST(1 AS DOUBLE) AS score, s_acctbal AS weight FROM supplier WHERE starts_with(s_name, 'Supplier#00000000')),
 u AS (SELECT 'polities' AS "group", key, name, score, peak AS weight FROM hits UNION ALL SELECT 'places', key, name, score, weight FROM places),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "group" ORDER BY score, weight DESC, name, key) AS INTEGER) AS rank FROM u) SELECT * FROM r WHERE rank <= CASE "group" WHEN 'polities' THEN 6 ELSE 4 END""",
)
def _(s, d):
    places = derived.table(s, d, "supplier").where(F.col("s_name").startswith("Supplier#00000000")).select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(1.0).alias("score"), F.col("s_acctbal").alias("weight"))
    return search.grouped({"polities": hits(s, d).select("key", "name", "score", F.col("peak").alias("weight")), "places": places})


@query("q5_activation", "SELECT l_partkey AS person, CAST(least(greatest(1999, min(year(l_shipdate))), max(year(l_shipdate))) AS INTEGER) AS goes_to FROM lineitem GROUP BY 1")
def _(s, d):
    spans = derived.assertions(s, d).groupBy("person").agg(F.min("fy").alias("first"), F.max("fy").alias("last"))
    return search.activation(spans, 1999).select("person", "goes_to")


@query(
    "j14_alias_links",
    """WITH a AS (SELECT p_name AS canonical, concat(p_type, CASE WHEN p_size < 9 THEN '' ELSE '*' END) AS name, min(p_partkey) AS ord FROM part GROUP BY 1, 2),
 i AS (SELECT p_name AS name, min(p_partkey) AS key FROM part WHERE p_brand <> 'Brand#2' AND p_size > 30 GROUP BY 1)
 SELECT canonical, key, string_agg(a.name, ',' ORDER BY ord, a.name) AS variants FROM a LEFT JOIN i ON i.name = canonical GROUP BY 1, 2""",
)
def _(s, d):
    p = derived.table(s, d, "part")
    alias = p.select(F.col("p_name").alias("canonical"), F.concat("p_type", F.when(F.col("p_size") < 9, "").otherwise("*")).alias("name"), F.col("p_partkey").alias("ord"))
    known = p.where("p_brand <> 'Brand#2' AND p_size > 30").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("key"))
    return search.alias_links(alias, known).select("canonical", "key", F.array_join("variants", ",").alias("variants"))


@query("j15_unique_links", "WITH u AS (SELECT p_name AS name, min(p_brand) AS key FROM part WHERE p_size > 48 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1) SELECT p_partkey, u.key FROM part LEFT JOIN u ON u.name = p_name")
def _(s, d):
    p = derived.table(s, d, "part")
    return search.unique_links(p.select("p_partkey", F.col("p_name").alias("name")), p.where("p_size > 48").select(F.col("p_name").alias("name"), F.col("p_brand").alias("key"))).select("p_partkey", "key")


@query(
    "a23_components",
    """WITH RECURSIVE e0 AS (SELECT c_custkey AS a, (c_custkey + 1 + c_nationkey) % (SELECT count(*) FROM customer) AS b FROM customer), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
 r(node, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.node) SELECT node, min(c) AS component FROM r GROUP BY 1""",
)
def _(s, d):
    c = derived.table(s, d, "customer")
    return identity.components(c.select(F.col("c_custkey").alias("a"), ((F.col("c_custkey") + 1 + F.col("c_nationkey")) % c.count()).alias("b")))


@query("w14_keepers", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P', o_orderpriority = '5-LOW', o_totalprice > 200000 DESC, o_orderpriority = '1-URGENT' DESC, o_orderkey) AS nth FROM orders) SELECT o_custkey AS person, o_orderkey AS id FROM r WHERE nth = 1")
def _(s, d):
    flags = {"uncertain": F.col("o_orderstatus") == "P", "approximate": F.col("o_orderpriority") == "5-LOW", "corroborated": F.col("o_totalprice") > 200000, "specific": F.col("o_orderpriority") == "1-URGENT"}
    rows = derived.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person"), *[v.alias(k) for k, v in flags.items()])
    return identity.keepers(rows, ["person"]).select("person", "id")


@query(
    "a24_duplicates",
    f"""WITH {ROWS}, g AS (SELECT *, CASE WHEN src = 's0' THEN '*' || role ELSE role END AS office FROM claim), o AS (SELECT *, list(DISTINCT office) FILTER (WHERE office NOT LIKE '*%') OVER (PARTITION BY polity, person, "from", "to") AS offices FROM g),
 n AS (SELECT *, CASE WHEN office LIKE '*%' AND len(coalesce(offices, [])) = 1 THEN offices[1] ELSE office END AS r FROM o)
 SELECT polity, person, "from", "to", r AS role, string_agg(id, ',' ORDER BY id) AS ids FROM n GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1""",
)
def _(s, d):
    rows = claim_rows(s, d).withColumn("role", F.when(F.col("src") == "s0", F.concat(F.lit("*"), "role")).otherwise(F.col("role")))
    return identity.duplicates(rows).withColumn("ids", F.array_join("ids", ","))


@query("a25_interval_audit", f"""WITH {ROWS} SELECT polity, "from", "to", count(*) AS rows, count(DISTINCT person) AS people, CASE WHEN count(DISTINCT person) = 1 THEN 'one' ELSE 'several' END AS kind FROM claim GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(s, d):
    return identity.interval_audit(claim_rows(s, d))


CONFLICTS = ROWS + ', c AS (SELECT a.id AS a, b.id AS b, a.person, a.polity FROM claim a JOIN claim b ON a.polity = b.polity AND a.person = b.person AND a.role = b.role AND a.id < b.id AND a."from" < b."to" AND b."from" < a."to" AND (a."from" <> b."from" OR a."to" <> b."to"))'


def wide_rows(s, d):
    return claim_rows(s, d).withColumn("to", F.col("to") + 1)


@query("j32_conflicts", f"WITH {CONFLICTS.replace('min(ty) AS', 'min(ty) + 1 AS')} SELECT * FROM c")
def _(s, d):
    return identity.conflicts(wide_rows(s, d))


@query("e13_withheld", f"WITH {CONFLICTS.replace('min(ty) AS', 'min(ty) + 1 AS')} SELECT polity, count(*) AS kept FROM claim WHERE id NOT IN (SELECT a FROM c UNION ALL SELECT b FROM c) GROUP BY 1")
def _(s, d):
    rows = wide_rows(s, d)
    return identity.withheld(rows, identity.conflicts(rows)).groupBy("polity").agg(F.count(F.lit(1)).alias("kept"))


@query("j33_held_incomplete", f"""WITH {OPEN} SELECT o.id, string_agg(DISTINCT p.id, ',' ORDER BY p.id) AS peers FROM part_known o JOIN part_known p ON o."to" IS NULL AND p."to" IS NOT NULL AND o.polity = p.polity AND o.person = p.person AND o."from" = p."from" GROUP BY 1""")
def _(s, d):
    return identity.held_incomplete(open_rows(s, d)).withColumn("peers", F.array_join("peers", ","))


@query("j34_superseding", "SELECT count(*) AS rows, sum(id) AS ids FROM (SELECT o_orderkey * 2 AS id FROM orders WHERE o_orderkey % 5 > 0 UNION ALL SELECT o_orderkey * 2 + 1 FROM orders WHERE o_orderkey % 5 = 0)")
def _(s, d):
    o = derived.table(s, d, "orders")
    year, key = F.year("o_orderdate"), F.col("o_orderkey")
    old = o.select((key * 2).alias("id"), F.col("o_custkey").alias("person"), year.alias("from"), F.lit(None).cast("int").alias("to"))
    new = o.where("o_orderkey % 5 = 0").select((key * 2 + 1).alias("id"), F.col("o_custkey").alias("person"), year.alias("from"), (year + 1).alias("to"))
    replaced = new.select("id", (F.col("id") - 1).alias("old"))
    return identity.superseding(old.unionByName(new), replaced).agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))


@query(
    "j28_redirects",
    """WITH RECURSIVE r AS (SELECT c_custkey AS page, CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 1 WHEN c_custkey % 50 = 2 THEN c_custkey - 1 ELSE c_custkey - 3 END AS target FROM customer WHERE c_nationkey > 11 AND c_custkey > 2 OR c_custkey % 50 IN (1, 2)),
 w(page, here, n) AS (SELECT page, target, 1 FROM r UNION ALL SELECT w.page, r.target, n + 1 FROM w JOIN r ON r.page = w.here WHERE n < 60),
 e AS (SELECT page, max(here) FILTER (WHERE here NOT IN (SELECT page FROM r)) AS target FROM w GROUP BY 1)
 SELECT c_custkey AS page, CASE WHEN e.page IS NULL THEN c_custkey ELSE e.target END AS target FROM customer LEFT JOIN e ON e.page = c_custkey""",
)
def _(s, d):
    c = derived.table(s, d, "customer")
    page = F.col("c_custkey")
    target = F.when(page % 50 == 1, page + 1).when(page % 50 == 2, page - 1).otherwise(page - 3)
    moves = c.where("c_nationkey > 11 AND c_custkey > 2 OR c_custkey % 50 IN (1, 2)").select(page.alias("page"), target.alias("target"))
    return identity.redirected(c.select(page.alias("page")), moves)


@query("j29_by_alias", """WITH a AS (SELECT p_brand AS polity, p_name AS name, min(p_partkey) AS person FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) = 1) SELECT p_partkey AS id, a.person FROM part LEFT JOIN a ON a.polity = p_brand AND a.name = p_name""")
def _(s, d):
    p = derived.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("polity"), F.col("p_name").alias("name"))
    return identity.by_alias(p, p.select("polity", "name", F.col("id").alias("person"))).select("id", "person")


@query(
    "j30_by_suffix",
    """WITH f AS (SELECT p_brand AS polity, p_partkey AS person, p_name AS name FROM part WHERE p_size > 25), s AS (SELECT p_partkey AS id, p_brand AS polity, split_part(p_name, ' ', 2) AS name FROM part WHERE p_size <= 25),
 j AS (SELECT s.id, min(f.person) AS person, count(DISTINCT f.person) AS n FROM s JOIN f ON f.polity = s.polity AND ends_with(f.name, ' ' || s.name) WHERE length(s.name) >= 5 GROUP BY 1)
 SELECT s.id, CASE WHEN j.n = 1 THEN j.person END AS person FROM s LEFT JOIN j USING (id)""",
)
def _(s, d):
    p = derived.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("polity"), F.col("p_name").alias("name"), "p_size")
    short = p.where("p_size <= 25").select("id", "polity", F.split("name", " ")[1].alias("name"))
    return identity.by_suffix(short, p.where("p_size > 25").select("polity", F.col("id").alias("person"), "name")).select("id", "person")


@query(
    "j20_peers",
    f"""WITH {ROWS}, l AS (SELECT *, person % 40 AS name FROM claim WHERE src = 's0'), r AS (SELECT *, person % 40 AS name FROM claim WHERE src <> 's0' AND person % 3 > 0),
 d AS (SELECT DISTINCT l.id, r.id AS peer FROM l JOIN r ON l.polity = r.polity AND l.role = r.role AND l.person = r.person AND l.lineage <> r.lineage AND l."from" <= r."to" AND r."from" <= l."to"),
 n AS (SELECT DISTINCT l.id, r.id AS peer, r.person FROM l JOIN r ON l.polity = r.polity AND l.role = r.role AND l.name = r.name AND l.lineage <> r.lineage AND l."from" <= r."to" AND r."from" <= l."to" WHERE l.id NOT IN (SELECT id FROM d))
 SELECT id, peer, 'person' AS "by" FROM d UNION ALL SELECT id, peer, 'name' FROM n WHERE id IN (SELECT id FROM n GROUP BY 1 HAVING count(DISTINCT person) = 1)""",
)
def _(s, d):
    rows = claim_rows(s, d).withColumn("name", F.col("person") % 40)
    return identity.peers(rows.where("src = 's0'"), rows.where("src <> 's0' AND person % 3 > 0"))


@query(
    "e14_disposed",
    f"""WITH {OPEN}, n AS (SELECT * FROM part_known WHERE src = 's1'), x AS (SELECT polity, person, role, "from" AS f, "to" AS t FROM claim WHERE src IN ('s2', 's3')),
 j AS (SELECT n.id, count(x.f) AS peers, coalesce(bool_or(x.f = n."from" AND x.t IS NOT DISTINCT FROM n."to"), false) AS eq, coalesce(bool_or(x.f <= n."to" AND x.t >= n."from" AND (x.f <> n."from" OR x.t <> n."to")), false) AS against, bool_or(n."to" IS NULL) AS open
 FROM n LEFT JOIN x USING (polity, person, role) GROUP BY 1) SELECT id, CASE WHEN open AND peers > 0 THEN 'candidateDuplicate' WHEN against THEN 'conflict' WHEN eq THEN 'matched' ELSE 'import' END AS disposition FROM j""",
)
def _(s, d):
    return identity.disposed(open_rows(s, d).where("src = 's1'"), claim_rows(s, d).where("src IN ('s2', 's3')"))


@query("j36_rosters", "SELECT l_partkey AS person, count(*) AS left_n, count(*) FILTER (WHERE l_linenumber <> 3) AS right_n FROM lineitem GROUP BY 1 HAVING count(*) <> count(*) FILTER (WHERE l_linenumber <> 3)")
def _(s, d):
    rows = derived.table(s, d, "lineitem").select(F.col("l_partkey").alias("person"), F.col("l_orderkey").alias("id"), "l_linenumber")
    return identity.unequal_rosters(rows, rows.where("l_linenumber <> 3"), "person", "id")


@query("u5_first_of_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(s, d):
    return identity.first_of(derived.table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("u7_repeated_ids", f"WITH {ASR} SELECT rid AS id, count(*) AS n FROM asr GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return identity.repeated_ids(derived.assertions(s, d).withColumnRenamed("rid", "id"))


@query("u9_across_phases", f"""WITH {ROWS} SELECT id, 'early' AS phase FROM claim WHERE "from" < 1999 UNION ALL SELECT id, 'late' FROM claim WHERE "to" >= 1999""")
def _(s, d):
    return identity.across_phases(claim_rows(s, d), 1999).select("id", "phase")
