"""Queries of published-table checks, outlines of pages, rasters and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.operators import rasters, validators, views
from tempora.plans.catalog import BOXES, IV, SERIES, YEAR, iv, query
from tempora.sources import derived, layers, outline
from tempora.streaming import snapshots


def checks_sql(with_: str, *rows: tuple[str, str, float, float]) -> str:
    parts = [f"SELECT '{name}' AS \"check\", CAST(({value}) AS DOUBLE) AS found, CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, coalesce(({value}) BETWEEN {lo} AND {hi}, FALSE) AS fine" for name, value, lo, hi in rows]
    return f"WITH {with_} " + " UNION ALL ".join(parts)


@query("v2_arbitrated", checks_sql(IV, ("wrappers", "SELECT count(*) FILTER (WHERE n LIKE '(%') FROM iv", 0, 0), ("old names", "SELECT count(*) FILTER (WHERE n = 'Customer#000000007' AND f < -500) FROM iv", 0, 0)))
def _(s, d):
    return validators.arbitrated(iv(s, d), ["Customer#000000007"], -500)


@query("v3_preceded", checks_sql(IV, ("tier 1", "SELECT count(*) FROM iv WHERE tier = 1", 2, 2), ("undeclared", "SELECT count(*) FROM iv WHERE tier = 1", 0, 0), ("missing", "SELECT 2", 0, 0), ("foreign sources", "SELECT count(*) FILTER (WHERE s NOT LIKE '1-%') FROM iv WHERE tier = 1", 0, 0)))
def _(s, d):
    return validators.preceded(iv(s, d), [("nobody", 1, 2), ("no one", 3, 4)], "1-")


@query(
    "v4_misplaced_labels",
    f"""WITH {BOXES}, q AS (SELECT DISTINCT n, 0 AS year FROM boxes WHERE k % 3 = 0), m AS (SELECT q.n, q.year, arg_max(b.x0, struct_pack(a := b.a, e := -b.f)) AS x, arg_max(b.y0, struct_pack(a := b.a, e := -b.f)) AS y FROM q LEFT JOIN boxes b ON b.n = q.n AND b.f <= 0 AND b.t >= 0 GROUP BY 1, 2)
 SELECT n, year, x, y FROM m WHERE NOT coalesce(x BETWEEN -90 AND 90 AND y BETWEEN -45 AND 45, FALSE)""",
)
def _(s, d):
    b = derived.boxes(s, d).select("n", "f", "t", "a", F.col("x0").alias("x"), F.col("y0").alias("y"), "k")
    wanted = b.where("k % 3 = 0").select("n").distinct().select("n", F.lit(YEAR).alias("year"), F.lit(-90).alias("bx0"), F.lit(-45).alias("by0"), F.lit(90).alias("bx1"), F.lit(45).alias("by1"))
    return validators.misplaced_labels(b.drop("k"), wanted)


@query("v5_wrong_facts", f"WITH {IV}, x AS (SELECT n AS name, min(f) AS first, max(a) AS peak FROM iv GROUP BY n) SELECT name, 'first' AS what, CAST(first AS DOUBLE) AS value FROM x WHERE first NOT BETWEEN -1100 AND 900 UNION ALL SELECT name, 'peak', CAST(peak AS DOUBLE) FROM x WHERE peak NOT BETWEEN 100000 AND 450000")
def _(s, d):
    index = iv(s, d).groupBy(F.col("n").alias("name")).agg(F.min("f").alias("first"), F.max("a").alias("peak"))
    fact = lambda what, lo, hi: index.select("name", F.lit(what).alias("what"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    return validators.wrong_facts(index, fact("first", -1100, 900).unionByName(fact("peak", 100_000, 450_000)))


@query("v5_lacking", f"WITH {IV}, x AS (SELECT n AS name, list(DISTINCT tier) AS tiers FROM iv GROUP BY n) SELECT name, m AS member FROM x, range(1, 4) r(m) WHERE NOT list_contains(tiers, m)")
def _(s, d):
    index = iv(s, d).groupBy(F.col("n").alias("name")).agg(F.collect_set("tier").alias("tiers"))
    return validators.lacking(index, index.select("name", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("member")), "tiers")


@query("v6_series", checks_sql(SERIES + ", x AS (SELECT year, CAST(sum(value) AS BIGINT) AS value FROM series GROUP BY year)", ("points", "SELECT count(*) FROM x", 90, 90), ("repeated years", "SELECT count(*) - count(DISTINCT year) FROM x", 0, 0), ("last", "SELECT arg_max(value, year) FROM x", 1, 1000)))
def _(s, d):
    return validators.series_checks(derived.series(s, d).groupBy("year").agg(F.sum("value").alias("value")), 90, 1, 1000)


@query("v7_agreements", checks_sql(IV, ("iou 117", "SELECT max(k % 100 / 100.0) FROM iv WHERE f <= 117 AND t >= 117 AND tier = 1", 0.7, 1), ("iou 200", "SELECT max(k % 100 / 100.0) FROM iv WHERE f <= 200 AND t >= 200 AND tier = 1", 0.75, 1)))
def _(s, d):
    r = iv(s, d).where("tier = 1")
    at = lambda y: r.where(f"f <= {y} AND t >= {y}").select(F.lit(y).alias("year"), (F.col("k") % 100 / 100.0).alias("iou"))
    return validators.agreement_checks(at(117).unionByName(at(200)), [(117, 0.7), (200, 0.75)])


@query("v8_layers", checks_sql("l AS (SELECT c_nationkey % 8 AS r FROM customer)", ("features", "SELECT count(*) FROM l", 100, 2000), ("odd ranks", "SELECT count(*) FILTER (WHERE r > 6) FROM l", 0, 0)))
def _(s, d):
    return validators.layer_checks(derived.table(s, d, "customer").select((F.col("c_nationkey") % 8).alias("r")), 100, 2000)


@query("a29_raster_checks", checks_sql("l AS (SELECT p_size AS value FROM part)", ("cells", "SELECT count(*) FROM l", 200, 200), ("median", "SELECT median(value) FROM l", 20, 30)))
def _(s, d):
    return validators.raster_checks(derived.table(s, d, "part").select(F.col("p_size").alias("value")), 200, 20, 30)


@query("s15_relief", "WITH m AS (SELECT p_size AS middle FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT p_partkey, CAST(greatest(0, least(255, 128 + 2 * ((p_size // 10) - (SELECT q FROM (SELECT p_size // 10 AS q, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, q LIMIT 1))))) AS INTEGER) AS shade FROM part")
def _(s, d):
    return layers.relief(derived.table(s, d, "part").select("p_partkey", F.floor(F.col("p_size") / 10).cast("int").alias("value"))).select("p_partkey", "shade")


WINDOW = "CASE WHEN abs({t}) >= 3 THEN 0 WHEN {t} = 0 THEN 1 ELSE 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * pi() * {t} * {t}) END"


@query(
    "s15_resampled",
    f"""WITH c AS (SELECT c_custkey % 60 AS x, c_custkey // 60 AS y, CAST(c_acctbal AS DOUBLE) AS v FROM customer), o AS (SELECT a.i AS x, b.j AS y FROM range(20) a(i), (SELECT unnest(range(0, 1 + CAST(max(y) AS BIGINT) // 2)) AS j FROM c) b),
 r AS (SELECT 1 + max(y) AS h FROM c), w AS (SELECT o.x, o.y, c.v, {WINDOW.format(t='((c.x + 0.5e0 - (o.x + 0.5e0) * 3) / 3)')} * {WINDOW.format(t='((c.y + 0.5e0 - (o.y + 0.5e0) * (h / n)) / greatest(1, h / n))')} AS w
  FROM o, r, (SELECT count(DISTINCT y) AS n FROM o) m JOIN c ON abs(c.x + 0.5 - (o.x + 0.5) * 3) < 9 AND abs(c.y + 0.5 - (o.y + 0.5) * (h / n)) < 3 * greatest(1, h / n))
 SELECT x, y, round(sum(w * v) / sum(w), 4) AS value FROM w GROUP BY x, y HAVING abs(sum(w)) > 1e-9""",
)
def _(s, d):
    """A raster of balances, a third as wide and about half as high."""
    k = F.col("c_custkey")
    cells = derived.table(s, d, "customer").select((k % 60).alias("x"), F.floor(k / 60).alias("y"), F.col("c_acctbal").cast("double").alias("value"))
    top = cells.agg(F.max("y")).first()[0]
    return rasters.resampled(cells, 60, top + 1, 20, top // 2 + 1, tile=16).select("x", "y", F.round("value", 4).alias("value"))


@query("v9_headline", f"WITH {IV} SELECT 'records' AS what, 1499 AS told, (SELECT count(*) FROM iv) AS real, (SELECT count(*) FROM iv) = 1499 AS fine UNION ALL SELECT 'identities', 150, (SELECT count(DISTINCT k) FROM iv), (SELECT count(DISTINCT k) FROM iv) = 150 UNION ALL SELECT 'mapped', 7, (SELECT count(DISTINCT k) FROM iv WHERE f <= 0 AND t >= 0), (SELECT count(DISTINCT k) FROM iv WHERE f <= 0 AND t >= 0) = 7")
def _(s, d):
    told = s.createDataFrame([("records", 1499), ("identities", 150), ("mapped", 7)], "what string, told int")
    return validators.headline(iv(s, d), told, YEAR)


@query("x19_holders", f"WITH {IV}, r AS (SELECT k % 40 AS polity, n AS name, f <= 0 AND t >= 0 AND tier = 1 AS act, f <= 0 AND t >= 0 AND tier <> 1 AS may FROM iv) SELECT polity, array_to_string(CASE WHEN bool_or(act) THEN list(name ORDER BY name) FILTER (WHERE act) ELSE coalesce(list(name ORDER BY name) FILTER (WHERE may), []) END, ',') AS names, bool_or(act) AS certain FROM r GROUP BY 1")
def _(s, d):
    on = (F.col("f") <= YEAR) & (F.col("t") >= YEAR)
    r = iv(s, d).select((F.col("k") % 40).alias("polity"), F.col("n").alias("name"), (on & (F.col("tier") == 1)).alias("active"), (on & (F.col("tier") != 1)).alias("possibly_active"))
    return views.holders(r).withColumn("names", F.array_join("names", ","))


# Pages that a query makes itself, so that lists, tables and infoboxes have rows to give


def roster_pages(s, d):
    """A page for each nation: a list, a nested list, a table and an infobox of what its number makes of them."""
    n = F.col("n_nationkey")
    year = lambda add: (n * 10 + 100 + add).cast("string")
    item = lambda name, a, b: F.concat(F.lit(f'<li><b><a href="/wiki/{name}">{name}</a></b> ('), year(a), F.lit("–"), year(b), F.lit(")<sup class='reference'>[1]</sup></li>"))
    html = F.concat(
        F.lit("<html><body><h2>Rulers of "), F.col("n_name"), F.lit("</h2><h3>Early</h3><ul>"), item("Ann", 0, 5), item("Bob", 5, 9), F.lit("<li>nobody here</li><li>Vacant (1200–1201)</li></ul><h3>Late</h3><ul><li>Kings:<ul><li>Cid ("),
        year(10), F.lit("–"), year(12), F.lit(", "), year(20), F.lit("–"), year(22), F.lit(")</li></ul></li></ul><table><tr><th>Name<th>Reign<th>House</tr><tr><td>Dan<td>"), year(30), F.lit("–"), year(34),
        F.lit("<td>X</tr><tr><td colspan=3>Second house</tr><tr><td>Eve<td>unknown<td>Y</tr></table><table><tr><th colspan=2>President</tr><tr><td>"), year(40), F.lit(" – "), year(44), F.lit("<td>Fay</tr><tr><td>Seat<td>Town</tr></table></body></html>"),
    )
    return derived.table(s, d, "nation").select(n.alias("id"), F.col("n_name").alias("title"), html.alias("html"))


@query("s22_list_records", "SELECT n_nationkey AS id, name, '/wiki/' || name AS href, concat('Rulers of ', n_name, '|Early') AS section, n_nationkey * 10 + 100 + a AS f, n_nationkey * 10 + 100 + b AS t FROM nation, (VALUES ('Ann', 0, 5), ('Bob', 5, 9)) v(name, a, b)")
def _(s, d):
    found = outline.list_records(outline.outline(roster_pages(s, d), "id", "html"), "id").where("href IS NOT NULL")
    return found.select("id", "name", "href", F.array_join("section", "|").alias("section"), "f", "t")


@query("s23_nested_records", "SELECT n_nationkey AS id, 'Late' AS jurisdiction, 'Kings' AS office, 'Cid' AS name, CAST(e AS INTEGER) AS episode, CAST(n_nationkey * 10 + 100 + e * 10 AS INTEGER) AS f, CAST(n_nationkey * 10 + 102 + e * 10 AS INTEGER) AS t FROM nation, range(1, 3) r(e)")
def _(s, d):
    return outline.nested_records(outline.outline(roster_pages(s, d), "id", "html"), "id")


@query("s20_table_records", "SELECT n_nationkey AS id, name, CASE WHEN name = 'Dan' THEN n_nationkey * 10 + 130 END AS f, CASE WHEN name = 'Dan' THEN n_nationkey * 10 + 134 END AS t, skipped FROM nation, (VALUES ('Dan', NULL), ('Second house', 'label'), ('Eve', 'undated')) v(name, skipped)")
def _(s, d):
    return outline.table_records(roster_pages(s, d), "id", "html").select("id", "name", "f", "t", "skipped")


@query("s21_infobox_records", "SELECT n_nationkey AS id, 'President' AS office, 'Fay' AS name, n_nationkey * 10 + 140 AS f, n_nationkey * 10 + 144 AS t FROM nation")
def _(s, d):
    return outline.infobox_records(roster_pages(s, d), "id", "html").where("office = 'President'").select("id", "office", "name", "f", "t")


@query("x4_headings", "SELECT n_nationkey AS id, text FROM nation, (VALUES (0), (1), (2)) v(i), LATERAL (SELECT CASE i WHEN 0 THEN 'Rulers of ' || n_name WHEN 1 THEN 'Early' ELSE 'Late' END AS text)")
def _(s, d):
    return outline.outline(roster_pages(s, d), "id", "html").where("kind = 'heading'").select("id", "text")


@query("x2_linked_targets", "SELECT n_nationkey AS id, '/wiki/' || n_name AS href, 'Kings' AS scope FROM nation WHERE n_nationkey % 2 = 0")
def _(s, d):
    n = F.col("n_nationkey")
    label = F.when(n % 2 == 0, F.concat(F.lit("Kings of "), "n_name")).otherwise("List of kings")
    html = F.concat(F.lit('<p>See <a href="/wiki/'), F.col("n_name"), F.lit('#Kings">'), label, F.lit('</a> and <a href="#top">'), F.col("n_name"), F.lit("</a></p>"))
    pages = derived.table(s, d, "nation").select(n.alias("id"), html.alias("html"), F.col("n_name").alias("title"))
    return outline.linked_targets(outline.outline(pages, "id", "html"), "id", pages.select("id", "title"))


@query("stream_daily_counts", "SELECT date_trunc('day', ts) AS day, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def _(s, d):
    """The same plan as the stream's, over the whole table."""
    return snapshots.daily_counts(derived.table(s, d, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))
