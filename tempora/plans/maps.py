"""Queries of views, resolution and polygons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.functions import scalars as S
from tempora.operators import resolve, spatial, temporal, views
from tempora.plans.catalog import BEFORE, BOXES, IV, SERIES, SPANS, WINDOWS, YEAR, iv, query
from tempora.sources import derived

LIFE = IV + SPANS.format(src="iv")
NOW = "now AS (SELECT * FROM boxes WHERE f <= 0 AND t >= 0)"
OVER = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
CELLS = "unnest(range(CAST({t}.x0 AS BIGINT), CAST({t}.x1 AS BIGINT))) AS x, {t}.y0 AS yy0, {t}.y1 AS yy1"
#: What each tier-1 source of the derived records speaks for.
AUTHORITY = [("1-URGENT", -120, -60, 100, 50)]


def now(s, d):
    return temporal.active(derived.boxes(s, d), YEAR)


def cells_of(table: str, keep: str) -> str:
    return f"(SELECT {keep}, x, unnest(range(CAST(yy0 AS BIGINT), CAST(yy1 AS BIGINT))) AS y FROM (SELECT {keep}, {CELLS.format(t=table)} FROM {table}))"


@query("t1_snapshot_order", f"WITH {IV} SELECT k, a, f FROM iv WHERE f <= 0 AND t >= 0")
def _(s, d):
    return views.snapshot(iv(s, d), YEAR).select("k", "a", "f")


@query(
    "t5_places",
    f"""WITH {SERIES}, x AS (SELECT key, arg_max(year, year) FILTER (WHERE year <= 40) y0, arg_max(value, year) FILTER (WHERE year <= 40) v0, min(year) FILTER (WHERE year > 40) y1, arg_min(value, year) FILTER (WHERE year > 40) v1 FROM series GROUP BY key)
 SELECT key, round(CASE WHEN y0 = 40 OR y1 IS NULL THEN v0 ELSE exp(ln(v0) + (ln(v1) - ln(v0)) * (40 - y0) / (y1 - y0)) END, 6) AS value FROM x WHERE y0 = 40 OR (y0 IS NOT NULL AND CASE WHEN y1 IS NULL THEN 40 <= y0 + 50 ELSE y1 - y0 <= 3 END)""",
)
def _(s, d):
    return views.places(derived.series(s, d), 40, gap=3).select("key", F.round("value", 6).alias("value"))


@query("t6_by_largest", f"WITH {SERIES} SELECT key, max(value) AS largest FROM series GROUP BY key")
def _(s, d):
    return views.by_largest(derived.series(s, d))


@query("a14_place_index", f'WITH {SERIES} SELECT key, min(year) AS "first", max(year) AS "last", max(value) AS largest FROM series GROUP BY key')
def _(s, d):
    return views.place_index(derived.series(s, d))


@query("a13_catalog", f"WITH {LIFE} SELECT spans.k, first, last, (peak_year).f AS peak_year, peak_area, name, [lower(name)] AS names FROM (SELECT k, first, last, name, peak_area, arg_max(iv2, e) AS peak_year FROM (SELECT spans.*, iv AS iv2, struct_pack(a := iv.a, e := -iv.f) AS e FROM spans JOIN iv USING (k)) GROUP BY ALL) spans")
def _(s, d):
    return views.catalog(iv(s, d))


@query(
    "w6_major_changes",
    f"""WITH {IV}, b AS (SELECT k, sum(a) v FROM iv WHERE f <= {BEFORE} AND t >= {BEFORE} GROUP BY k), n AS (SELECT k, sum(a) v FROM iv WHERE f <= 0 AND t >= 0 GROUP BY k)
 SELECT k, CAST(b.v AS BIGINT) AS was, CAST(n.v - b.v AS BIGINT) AS delta, abs(n.v - b.v) >= 50000 OR abs(n.v - b.v) >= b.v * 0.25 AS major FROM b JOIN n USING (k) WHERE abs(n.v - b.v) >= 1000""",
)
def _(s, d):
    return views.major_changes(iv(s, d), BEFORE, YEAR)


CHANGES = f"""{IV}, b AS (SELECT k, sum(a) v FROM iv WHERE f <= {BEFORE} AND t >= {BEFORE} GROUP BY k), n AS (SELECT k, sum(a) v FROM iv WHERE f <= 0 AND t >= 0 GROUP BY k),
 j AS (SELECT k, b.v AS was, n.v AS seen, coalesce(n.v, 0) - coalesce(b.v, 0) AS delta FROM b FULL JOIN n USING (k))"""


@query(
    "t9_change_list",
    f"""WITH {CHANGES}, c AS (SELECT k, CASE WHEN was IS NULL THEN 'first' WHEN seen IS NULL THEN 'gone' WHEN abs(delta) >= 1000 THEN 'changed' END AS kind, delta FROM j),
 r AS (SELECT kind, k, delta, row_number() OVER (PARTITION BY kind ORDER BY abs(delta) DESC, k) AS rank FROM c WHERE kind IS NOT NULL)
 SELECT kind, CAST(rank AS INTEGER) AS rank, k, CAST(delta AS BIGINT) AS delta FROM r WHERE rank <= CASE kind WHEN 'changed' THEN 5 ELSE 6 END""",
)
def _(s, d):
    return views.change_list(iv(s, d), BEFORE, YEAR)


@query(
    "x16_emphasis",
    f"""WITH {CHANGES}, m AS (SELECT *, was IS NOT NULL AND seen IS NOT NULL AND abs(delta) >= 1000 AND (abs(delta) >= 50000 OR abs(delta) >= was * 0.25) AS lit FROM j),
 r AS (SELECT 'fresh' AS role, k, abs(delta) AS size FROM m WHERE was IS NULL UNION ALL SELECT 'lit', k, abs(delta) FROM m WHERE lit UNION ALL SELECT 'ghost', k, abs(delta) FROM m WHERE seen IS NULL OR (lit AND delta < 0))
 SELECT role, k, CAST(size AS BIGINT) AS size, role = 'ghost' AND row_number() OVER (PARTITION BY role ORDER BY size DESC, k) <= 2 AS labelled FROM r""",
)
def _(s, d):
    return views.emphasis(iv(s, d), BEFORE, YEAR)


@query("f6_in_screen", f"WITH {BOXES} SELECT k, f FROM boxes WHERE (x1 + 180) * 3 >= -8 AND (x0 + 180) * 3 - 500 <= 8 AND (y1 + 90) * 3 >= 200 AND (y0 + 90) * 3 <= 400")
def _(s, d):
    at = lambda c, off: (F.col(c) + off) * 3
    seen = views.in_screen(at("x0", 180), at("y0", 90) - 200, at("x1", 180), at("y1", 90) - 200, F.lit(500), F.lit(200), 0)
    wide = views.in_screen(at("x0", 180), at("y0", 90) - 200, at("x1", 180), at("y1", 90) - 200, F.lit(500), F.lit(200), 8)
    return derived.boxes(s, d).where(wide & (at("y1", 90) - 200 >= 0) & (at("y0", 90) - 200 <= 200) | seen).select("k", "f")


@query("f7_near_side", f"WITH {BOXES} SELECT k, f FROM boxes WHERE 2 * asin(least(1.0, sqrt(pow(sin((radians(20) - radians(y0)) / 2), 2) + cos(radians(y0)) * cos(radians(20)) * pow(sin((radians(10) - radians(x0)) / 2), 2)))) < pi() / 2 - 0.005")
def _(s, d):
    return derived.boxes(s, d).where(G.on_near_side(F.col("x0"), F.col("y0"), F.lit(10), F.lit(20))).select("k", "f")


@query(
    "f8_changes_in_view",
    f"""WITH {BOXES}, a AS (SELECT k, arg_max(x0, struct_pack(a := a, e := -f)) AS x, arg_max(y0, struct_pack(a := a, e := -f)) AS y FROM boxes WHERE f <= 0 AND t >= 0 GROUP BY k),
 b AS (SELECT k, sum(a) v FROM iv WHERE f <= {BEFORE} AND t >= {BEFORE} GROUP BY k), n AS (SELECT k, sum(a) v FROM iv WHERE f <= 0 AND t >= 0 GROUP BY k)
 SELECT n.k, CAST(n.v - b.v AS BIGINT) AS delta FROM b JOIN n USING (k) JOIN a ON a.k = n.k WHERE abs(n.v - b.v) >= 1000 AND x BETWEEN -50 AND 60 AND y BETWEEN -40 AND 45""",
)
def _(s, d):
    changes = views.major_changes(iv(s, d), BEFORE, YEAR).select("k", "delta")
    spots = views.anchors(derived.boxes(s, d), ["x0", "y0"], YEAR).withColumnsRenamed({"x0": "x", "y0": "y"})
    return views.changes_in_view(changes, spots, -50, -40, 60, 45)


@query("f9_by_rank", "SELECT c_custkey, c_nationkey % 7 AS r FROM customer WHERE c_nationkey % 7 <= 4")
def _(s, d):
    return views.by_rank(derived.table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 7).alias("r")), 2.5)


@query("x21_rank_limits", "SELECT c_custkey, CASE WHEN c_custkey % 9 < 1.6 THEN 3 WHEN c_custkey % 9 < 3 THEN 4 WHEN c_custkey % 9 < 6 THEN 5 ELSE 6 END AS river, CASE WHEN c_custkey % 9 < 1.6 THEN 1 WHEN c_custkey % 9 < 3 THEN 3 WHEN c_custkey % 9 < 6 THEN 5 ELSE 6 END AS lake FROM customer")
def _(s, d):
    zoom = (F.col("c_custkey") % 9).cast("double")
    return derived.table(s, d, "customer").select("c_custkey", views.rank_limit(zoom).alias("river"), views.rank_limit(zoom, "lake").alias("lake"))


@query("t10_label_candidates", f"WITH {BOXES} SELECT k, f, k % 10 = 0 AS lit, (x1 - x0) * (y1 - y0) AS size FROM boxes WHERE f <= 0 AND t >= 0")
def _(s, d):
    b = now(s, d)
    return views.label_candidates(b, b.where("k % 10 = 0")).select("k", "f", "lit", "size")


@query("w10_label_claims")
def _(s, d):
    order = (F.col("k") * 10_000 - F.col("f")).cast("long")
    view = F.floor(F.col("k") / 64).cast("int") * 100 + F.floor((F.col("f") + 2000) / 50).cast("int")
    return views.label_claims(derived.boxes(s, d).select(view.alias("view"), order.alias("ord"), "x0", "y0", "x1", "y1"))


@query(
    "p18_time_windows",
    """WITH p AS (SELECT c_custkey, CAST(c_custkey % 5424 - 3400 AS INTEGER) AS y, [NULL, '1000', '500', '100', '25'][c_custkey % 5 + 1] AS scope FROM customer),
 q AS (SELECT *, CAST(coalesce(scope, '100') AS INTEGER) AS w FROM p)
 SELECT c_custkey, CAST(greatest(-3400, least(2024 - w, floor(y - w / 2 + 0.5))) AS INTEGER) AS lo, CAST(greatest(-3400, least(2024 - w, floor(y - w / 2 + 0.5))) + w AS INTEGER) AS hi FROM q""",
)
def _(s, d):
    scope = F.element_at(F.array(F.lit(None).cast("string"), F.lit("1000"), F.lit("500"), F.lit("100"), F.lit("25")), (F.col("c_custkey") % 5 + 1).cast("int"))
    year = (F.col("c_custkey") % 5424 - 3400).cast("int")
    found = views.window_of(year, F.coalesce(scope, F.lit("any")), -3400, 2024)
    return derived.table(s, d, "customer").select("c_custkey", found["lo"].alias("lo"), found["hi"].alias("hi"))


@query("p36_markers", f"WITH {LIFE}, m AS (SELECT k, first, last, (arg_max(f, struct_pack(a := a, e := -f))) AS peak FROM iv JOIN spans USING (k) GROUP BY k, first, last) SELECT k, round(greatest(0, least(1, (peak - first) / greatest(1, last - first))), 9) AS peak, round(greatest(0, least(1, (0 - first) / greatest(1, last - first))), 9) AS now, 0 BETWEEN first AND last AS shown FROM m")
def _(s, d):
    m = views.markers(F.col("first"), F.col("last"), F.col("peak_year"), F.lit(YEAR))
    return temporal.lifespans(iv(s, d)).select("k", F.round(m["peak"], 9).alias("peak"), F.round(m["now"], 9).alias("now"), m["shown"].alias("shown"))


@query("x15_anchors", f"WITH {BOXES} SELECT k, arg_max(x0, struct_pack(a := a, e := -f)) AS x0, arg_max(y0, struct_pack(a := a, e := -f)) AS y0 FROM boxes WHERE f <= 0 AND t >= 0 GROUP BY k")
def _(s, d):
    return views.anchors(derived.boxes(s, d), ["x0", "y0"], YEAR)


@query("x17_next_change", f"WITH {IV}, y AS (SELECT DISTINCT year FROM (SELECT f AS year FROM iv UNION ALL SELECT t + 1 FROM iv)) SELECT 'next' AS way, min(year) AS year FROM y WHERE year > 0 AND year BETWEEN -500 AND 500 UNION ALL SELECT 'back', max(year) FROM y WHERE year < 0 AND year BETWEEN -500 AND 500")
def _(s, d):
    years = temporal.change_years(iv(s, d))
    way = lambda name, back: views.next_change(years, YEAR, -500, 500, back).select(F.lit(name).alias("way"), "year")
    return way("next", False).unionByName(way("back", True))


@query(
    "x18_summary",
    f"""WITH {LIFE}, n AS (SELECT k, sum(a) AS area FROM iv WHERE f <= 0 AND t >= 0 GROUP BY k)
 SELECT spans.k, first, last, peak_area, CAST(area AS BIGINT) AS area, CASE WHEN area IS NOT NULL THEN 'mapped' WHEN first > 0 THEN 'before' WHEN last < 0 THEN 'after' ELSE 'between' END AS status, round(coalesce(area / peak_area, 0), 9) AS share FROM spans LEFT JOIN n ON n.k = spans.k""",
)
def _(s, d):
    return views.summary(iv(s, d), YEAR).select("k", "first", "last", "peak_area", "area", "status", F.round("share", 9).alias("share"))


@query("x24_slider_years", "SELECT c_custkey, CAST(CASE WHEN floor(-50 + (c_custkey % 101) / 100.0 * 100 + 0.5) = 0 THEN 1 ELSE floor(-50 + (c_custkey % 101) / 100.0 * 100 + 0.5) END AS INTEGER) AS year FROM customer")
def _(s, d):
    at = (F.col("c_custkey") % 101) / F.lit(100.0)
    return derived.table(s, d, "customer").select("c_custkey", views.slider_year(at, F.lit("100"), F.lit(-50), F.lit(50), S.timeline_year).alias("year"))


@query("x25_entered_years", f"WITH {IV} SELECT k, f, CASE WHEN f <> 0 AND f BETWEEN -200 AND 300 THEN f END AS year FROM iv")
def _(s, d):
    return iv(s, d).select("k", "f", views.entered_year(S.parsed_year(S.year_text(F.col("f"))), -200, 300).alias("year"))


# Resolution


@query(
    "j3_authority_mask",
    f"WITH {BOXES}, {NOW} SELECT k, greatest(x0, -120) AS x0, greatest(y0, -60) AS y0, least(x1, 100) AS x1, least(y1, 50) AS y1 FROM now WHERE tier = 1 AND greatest(x0, -120) < least(x1, 100) AND greatest(y0, -60) < least(y1, 50)",
)
def _(s, d):
    authority = s.createDataFrame(AUTHORITY, "s string, bx0 int, by0 int, bx1 int, by1 int")
    return resolve.masked_by(now(s, d).where("tier = 1"), authority).select("k", "x0", "y0", "x1", "y1")


@query(
    "j2_remaining",
    f"""WITH {BOXES}, {NOW}, one AS (SELECT * FROM now WHERE tier = 1), two AS (SELECT * FROM now WHERE tier = 2), m AS (SELECT DISTINCT x, y FROM {cells_of('one', 'k')}),
 c AS (SELECT k, count(*) AS lost FROM {cells_of('two', 'k')} JOIN m USING (x, y) WHERE k % 10 <> 0 GROUP BY k)
 SELECT k AS id, (x1 - x0) * (y1 - y0) - coalesce(lost, 0) AS "left", (x1 - x0) * (y1 - y0) AS whole FROM two LEFT JOIN c USING (k) WHERE (x1 - x0) * (y1 - y0) > coalesce(lost, 0)""",
)
def _(s, d):
    n = now(s, d)
    return resolve.remaining(n.where("tier = 2").select(F.col("k").alias("id"), (F.col("k") % 10 == 0).alias("protected"), "x0", "y0", "x1", "y1"), n.where("tier = 1"))


@query(
    "g1_pieces",
    f"""WITH {BOXES}, p AS (SELECT *, x0 + 2 AS m0, y0 + 1 AS n0, x0 + 5 AS m1, y0 + 4 AS n1 FROM boxes) SELECT k, f, CAST((x1 - x0) * (y1 - y0) - greatest(0, least(x1, m1) - greatest(x0, m0)) * greatest(0, least(y1, n1) - greatest(y0, n0)) AS BIGINT) AS "left" FROM p
 WHERE (x1 - x0) * (y1 - y0) > greatest(0, least(x1, m1) - greatest(x0, m0)) * greatest(0, least(y1, n1) - greatest(y0, n0))""",
)
def _(s, d):
    b = derived.boxes(s, d).select("k", "f", "x0", "y0", "x1", "y1", (F.col("x0") + 2).alias("m0"), (F.col("y0") + 1).alias("n0"), (F.col("x0") + 5).alias("m1"), (F.col("y0") + 4).alias("n1"))
    parts = resolve.pieces(b, ["m0", "n0", "m1", "n1"])
    return parts.groupBy("k", "f").agg(F.sum(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("long")).alias("left"))


@query("j5_protected", f"WITH {IV} SELECT k, f, CASE WHEN tier = 1 THEN CASE {' '.join(f'WHEN f <= {hi} AND t >= {lo} THEN {i}' for i, (lo, hi) in enumerate(WINDOWS))} END END AS protected_in FROM iv")
def _(s, d):
    return resolve.protected_until(iv(s, d).withColumn("protected", F.col("tier") == 1), WINDOWS).select("k", "f", "protected_in")


@query(
    "j6_agreements",
    f"""WITH {BOXES}, a AS (SELECT *, k * 100000 + f AS id FROM boxes WHERE tier = 1), b AS (SELECT *, k * 100000 + f AS id FROM boxes WHERE tier = 2), p AS (SELECT a.id AS id1, b.id AS id2, a.k AS k1, {OVER} AS shared, (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM a JOIN b ON a.k // 2 = b.k // 2)
 SELECT id1, id2, round(shared / (sa + sb - shared), 4) AS iou, round(100 * sa / sb, 1) AS pct FROM p""",
)
def _(s, d):
    b = derived.boxes(s, d).select((F.col("k") * 100_000 + F.col("f")).alias("id"), F.floor(F.col("k") / 2).alias("wd"), F.col("n").alias("name"), "tier", "x0", "y0", "x1", "y1")
    return resolve.agreements(b.where("tier = 1"), b.where("tier = 2"))


@query(
    "j7_displaced",
    f"""WITH {BOXES}, p AS (SELECT k AS id, n AS name, (x1 - x0) * (y1 - y0) AS whole, (x1 - x0) * (y1 - y0) - k % 7 AS l FROM boxes WHERE f <= 0 AND t >= 0 AND tier = 2 AND (x1 - x0) * (y1 - y0) > k % 7),
 g AS (SELECT k AS id, n AS name FROM boxes WHERE f <= 0 AND t >= 0 AND tier = 3 AND k % 5 = 0)
 SELECT id, name, lost FROM (SELECT id, name, 100.0 AS lost FROM g UNION ALL SELECT id, name, round(100 * (1 - l / whole), 1) FROM p WHERE 1 - l / whole > 0.001 AND name NOT IN (SELECT name FROM g)) ORDER BY lost DESC, name, id LIMIT 15""",
)
def _(s, d):
    n, size = now(s, d), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    part = n.where("tier = 2").select(F.col("k").alias("id"), F.col("n").alias("name"), size.alias("whole"), (size - F.col("k") % 7).alias("left")).where("left > 0")
    return resolve.displaced(part, n.where("tier = 3 AND k % 5 = 0").select(F.col("k").alias("id"), F.col("n").alias("name")))


@query(
    "a5_coverage",
    f"""WITH {BOXES}, {NOW}, v AS (SELECT k, greatest(x0, -60) AS x0, greatest(y0, -40) AS y0, least(x1, 60) AS x1, least(y1, 40) AS y1 FROM now WHERE greatest(x0, -60) < least(x1, 60) AND greatest(y0, -40) < least(y1, 40)),
 c AS (SELECT count(*) AS cells FROM (SELECT DISTINCT x, y FROM {cells_of('v', 'k')})) SELECT cells, round(100 * cells / 9600, 1) AS covered, round(100 - 100 * cells / 9600, 1) AS uncovered FROM c""",
)
def _(s, d):
    return resolve.coverage(now(s, d), -60, -40, 60, 40)


@query("a4_union_sizes", f"WITH {BOXES}, {NOW} SELECT tier, count(*) AS cells FROM (SELECT DISTINCT tier, x, y FROM {cells_of('now', 'tier')}) GROUP BY tier")
def _(s, d):
    return resolve.union_size(now(s, d), ["tier"])


@query("s6_constant_source", f"WITH {BOXES} SELECT 'layer' AS s, -400 AS f, 300 AS t, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes WHERE tier = 1")
def _(s, d):
    return resolve.constant_source(derived.boxes(s, d).where("tier = 1"), "layer", -400, 300)


@query(
    "u2_resolved",
    f"""WITH {BOXES}, {NOW}, one AS (SELECT * FROM now WHERE tier = 1), two AS (SELECT * FROM now WHERE tier = 2 AND k NOT IN (SELECT k FROM one)), m AS (SELECT DISTINCT x, y FROM {cells_of('one', 'k')}),
 c AS (SELECT k, count(*) AS lost FROM {cells_of('two', 'k')} JOIN m USING (x, y) GROUP BY k)
 SELECT k, tier, (x1 - x0) * (y1 - y0) AS cells FROM one UNION ALL SELECT k, 2, (x1 - x0) * (y1 - y0) - coalesce(lost, 0) FROM two LEFT JOIN c USING (k) WHERE (x1 - x0) * (y1 - y0) > coalesce(lost, 0)""",
)
def _(s, d):
    return resolve.resolved(derived.boxes(s, d), YEAR)


REGIONS = "r AS (SELECT CAST(i AS VARCHAR) || ':' || CAST(j AS VARCHAR) AS name, -180 + 12 * i AS x0, -90 + 9 * j AS y0, -168 + 12 * i AS x1, -81 + 9 * j AS y1 FROM range(30) a(i), range(20) b(j))"


def regions(s):
    grid = s.range(600).select((F.col("id") % 30).alias("i"), F.floor(F.col("id") / 30).alias("j"))
    corner = lambda c, at, step: (F.lit(at) + F.lit(step) * F.col(c)).cast("int")
    return grid.select(F.concat("i", F.lit(":"), "j").alias("name"), corner("i", -180, 12).alias("x0"), corner("j", -90, 9).alias("y0"), corner("i", -168, 12).alias("x1"), corner("j", -81, 9).alias("y1"))


@query(
    "j11_shares",
    f"""WITH {BOXES}, {REGIONS}, m AS (SELECT a.k, b.name, {OVER} AS shared, 100 * {OVER} / 108 AS share FROM boxes a JOIN r b ON a.f <= 0 AND a.t >= 0 AND {OVER} > 0),
 q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY shared DESC, name) AS rank FROM m WHERE share >= 3) SELECT k, CAST(rank AS INTEGER) AS rank, name, CAST(round_even(share, 0) AS INTEGER) AS pct FROM q WHERE rank <= 8""",
)
def _(s, d):
    return resolve.shares(now(s, d), regions(s), most=8)


@query(
    "x22_overlapping_claims",
    f"""WITH {BOXES}, y AS (SELECT CAST(year AS INTEGER) AS year FROM range(-300, 301, 100) r(year)), q AS (SELECT boxes.*, year FROM boxes JOIN y ON f <= year AND t >= year)
 SELECT a.k AS k1, b.k AS k2, count(DISTINCT a.year) AS years FROM q a JOIN q b ON a.year = b.year AND a.k < b.k WHERE {OVER} > 0 AND {OVER} >= 0.3 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) GROUP BY 1, 2""",
)
def _(s, d):
    return resolve.overlapping_claims(derived.boxes(s, d), -300, 300, 100)


PARTS = """parts AS (SELECT k * 100000 + f AS rec, (k * 100000 + f) * 10 + i AS id, k, f, t, CASE i WHEN 0 THEN x0 WHEN 1 THEN x0 + 3 ELSE x0 + 30 END AS x0, y0, CASE i WHEN 0 THEN x0 + 2 WHEN 1 THEN x0 + 4 + a % 3 ELSE x0 + 31 + a % 9 END AS x1, y1 FROM boxes, range(3) p(i))"""


def parts(s, d):
    """Records in three parts each."""
    b = derived.boxes(s, d).withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    rec = F.col("k") * 100_000 + F.col("f")
    x, a, i = F.col("x0"), F.col("a"), F.col("i")
    return b.select(rec.alias("rec"), (rec * 10 + i).alias("id"), "k", "f", "t", F.when(i == 0, x).when(i == 1, x + 3).otherwise(x + 30).alias("x0"), "y0", F.when(i == 0, x + 2).when(i == 1, x + 4 + a % 3).otherwise(x + 31 + a % 9).alias("x1"), "y1")


TAKEN = f"""met AS (SELECT a.id, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x1, b.x1) AS x1, least(a.y1, b.y1) AS y1 FROM parts a JOIN boxes b ON a.k <> b.k AND b.f <= a.t AND b.t >= a.f AND {OVER} > 0),
 tk AS (SELECT id, count(*) AS taken FROM (SELECT DISTINCT id, x, y FROM {cells_of('met', 'id')}) GROUP BY id)"""


@query("j12_occupied", f"WITH {BOXES}, {PARTS}, {TAKEN} SELECT id, (x1 - x0) * (y1 - y0) AS cells, coalesce(taken, 0) AS taken FROM parts LEFT JOIN tk USING (id)")
def _(s, d):
    return resolve.occupied(parts(s, d), derived.boxes(s, d))


@query(
    "w13_anchors",
    f"""WITH {BOXES}, {PARTS}, {TAKEN}, h AS (SELECT k, min(x0) + 1 AS hx, min(y0) AS hy FROM boxes GROUP BY k),
 q AS (SELECT p.*, (x1 - x0) * (y1 - y0) AS size, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, hx, hy, coalesce(taken, 0) AS taken FROM parts p LEFT JOIN h USING (k) LEFT JOIN tk USING (id)),
 m AS (SELECT *, max(size) OVER (PARTITION BY rec) AS largest, row_number() OVER (PARTITION BY rec ORDER BY size DESC, id) AS place FROM q),
 n AS (SELECT *, coalesce(hx >= x0 AND hx < x1 AND hy >= y0 AND hy < y1 AND size >= 0.01 * largest, FALSE) AS home FROM m), o AS (SELECT *, bool_or(home) OVER (PARTITION BY rec) AS settled FROM n),
 r AS (SELECT *, CASE WHEN home THEN 'home' WHEN NOT settled AND place <= 5 AND 2 * taken < size THEN 'free' ELSE 'nearest' END AS why FROM o),
 z AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY CASE why WHEN 'home' THEN 0 WHEN 'free' THEN 1 ELSE 2 END, CASE why WHEN 'nearest' THEN coalesce(pow(x - hx, 2) + pow(y - hy, 2), 0) ELSE 0 END, place) AS i FROM r)
 SELECT rec, id, why, round(x, 3) AS x, round(y, 3) AS y FROM z WHERE i = 1""",
)
def _(s, d):
    homes = derived.boxes(s, d).groupBy("k").agg((F.min("x0") + 1).alias("hx"), F.min("y0").alias("hy"))
    return resolve.anchored(parts(s, d), homes, derived.boxes(s, d))


# Polygons: an L of each box, the upper right quarter cut out; the SQL knows its measures from the box.


def ells(s, d):
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    ring = F.array(*[G.point(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y), (x, y), (x, y1), (x0, y1), (x0, y0))])
    return derived.evenly(derived.boxes(s, d).select("k", "f", "x0", "y0", "x1", "y1"), "k", "f").withColumn("shape", F.array(F.array(ring)))


@query("g1_planar_area", f"WITH {BOXES} SELECT k, f, round(0.75 * (x1 - x0) * (y1 - y0), 6) AS area FROM boxes")
def _(s, d):
    return ells(s, d).select("k", "f", F.round(G.planar_area(F.col("shape")), 6).alias("area"))


def _sine(lat: str) -> str:
    e = "0.08181919084262149"
    q = lambda v: f"((1 - {e} * {e}) * ({v} / (1 - {e} * {e} * {v} * {v}) - ln((1 - {e} * {v}) / (1 + {e} * {v})) / (2 * {e})))"
    return f"({q(f'sin(radians({lat}))')} / {q('1.0')})"


@query(
    "p6_geodesic_area",
    f"""WITH {BOXES}, m AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM boxes)
 SELECT k, f, round((radians(x1 - x0) * ({_sine('y')} - {_sine('y0')}) + radians(x - x0) * ({_sine('y1')} - {_sine('y')})) * 6378.137 * 6378.137 * ((1 - 0.08181919084262149 * 0.08181919084262149) * (1 / (1 - 0.08181919084262149 * 0.08181919084262149) - ln((1 - 0.08181919084262149) / (1 + 0.08181919084262149)) / (2 * 0.08181919084262149))) / 2, 2) AS area FROM m""",
)
def _(s, d):
    return ells(s, d).select("k", "f", F.round(G.geodesic_area(F.col("shape")), 2).alias("area"))


@query(
    "p9_centroids",
    f"""WITH {BOXES}, m AS (SELECT *, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM boxes)
 SELECT k, f, round((w * h / 2 * (x0 + w / 2) + w * h / 4 * (x0 + w / 4)) / (0.75 * w * h), 6) AS x, round((w * h / 2 * (y0 + h / 4) + w * h / 4 * (y0 + 0.75 * h)) / (0.75 * w * h), 6) AS y FROM m""",
)
def _(s, d):
    return ells(s, d).select("k", "f", G.centroid(F.col("shape")).alias("c")).select("k", "f", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(
    "g1_clipped",
    f"""WITH {BOXES}, m AS (SELECT *, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM boxes) SELECT k, f, round(3 * w * h / 16, 6) AS inside, round(9 * w * h / 16, 6) AS outside FROM m""",
)
def _(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    window = (F.col("x0") + w / 4, F.col("y0") + h / 4, F.col("x0") + 3 * w / 4, F.col("y0") + 3 * h / 4)
    shape = F.col("shape")
    return ells(s, d).select("k", "f", F.round(G.planar_area(G.clipped(shape, *window)), 6).alias("inside"), F.round(G.planar_area(G.without(shape, *window)), 6).alias("outside"))


@query("j13_point_in_polygon", f"WITH {BOXES} SELECT k, f, TRUE AS low, FALSE AS high, TRUE AS own FROM boxes")
def _(s, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    at = lambda a, b: G.holds(F.col("shape"), F.col("x0") + w * a, F.col("y0") + h * b)
    own = G.inner_point(F.col("shape"))
    return ells(s, d).select("k", "f", at(0.25, 0.75).alias("low"), at(0.75, 0.75).alias("high"), G.let(own, lambda p: G.holds(F.col("shape"), p["x"], p["y"])).alias("own"))


@query("p8_rounded", f"WITH {BOXES} SELECT k, f, round((x0 + x1) / 2 / 7, 3) AS x, 7 AS corners FROM boxes")
def _(s, d):
    sevenths = G.mapped(F.col("shape"), lambda r: F.transform(r, lambda p: G.point(p["x"] / 7, p["y"] / 7)))
    return ells(s, d).select("k", "f", G.rounded(sevenths)[0][0].alias("r")).select("k", "f", F.col("r")[3]["x"].alias("x"), F.size("r").alias("corners"))


@query("g4_orientation", f"WITH {BOXES} SELECT k, f, round(-0.75 * (x1 - x0) * (y1 - y0), 6) AS outer, round(0.75 * (x1 - x0) * (y1 - y0), 6) AS back FROM boxes")
def _(s, d):
    turned = G.oriented(F.col("shape"))
    return ells(s, d).select("k", "f", F.round(G.ring_area(turned[0][0]), 6).alias("outer"), F.round(G.ring_area(G.oriented(turned, clockwise=False)[0][0]), 6).alias("back"))


@query("p5_repaired", f"WITH {BOXES} SELECT k, f, 7 AS corners, k % 2 = 0 AS lost FROM boxes")
def _(s, d):
    ring = F.col("shape")[0][0]
    broken = F.flatten(F.transform(F.slice(ring, 1, 6), lambda p: F.array(p, p)))  # every corner twice, and not closed
    line = F.array(F.array(F.array(ring[0], ring[1], ring[0])))
    fixed = G.repaired(F.array(F.array(broken)))
    return ells(s, d).select("k", "f", F.size(fixed[0][0]).alias("corners"), (G.repaired(F.when(F.col("k") % 2 == 0, line).otherwise(F.col("shape"))).isNull()).alias("lost"))


@query("p7_simplified", f"WITH {BOXES} SELECT k, f, 7 AS corners, round(0.75 * (x1 - x0) * (y1 - y0), 6) AS area FROM boxes")
def _(s, d):
    """Corners in the middle of every edge go, those of the L stay."""
    halves = F.flatten(G.edges(F.col("shape")[0][0], lambda p, q: F.array(p, G.point((p["x"] + q["x"]) / 2 + 0.0001, (p["y"] + q["y"]) / 2))))
    fine = F.concat(halves, F.slice(halves, 1, 1))
    line = ells(s, d).select("k", "f", G.simplified(F.array(F.array(fine)), 0.08).alias("g"))
    return line.select("k", "f", F.size(F.col("g")[0][0]).alias("corners"), F.round(G.planar_area(F.col("g")), 6).alias("area"))


@query("g6_projections", "SELECT c_custkey, round((c_custkey * 31) % 340 - 170.0, 6) AS lon, round((c_custkey * 17) % 160 - 80.0, 6) AS lat FROM customer")
def _(s, d):
    """There and back: Equal Earth for all, and a globe for what it shows."""
    c = F.col("c_custkey")
    lon, lat = (c * 31) % 340 - 170.0, (c * 17) % 160 - 80.0
    flat = G.let(G.equal_earth(lon, lat), lambda p: G.from_equal_earth(p["x"], p["y"]))
    seen = G.let(G.orthographic(lon, lat, F.lit(10.0), F.lit(20.0)), lambda p: G.from_orthographic(p["x"], p["y"], F.lit(10.0), F.lit(20.0)))
    both = derived.table(s, d, "customer").select("c_custkey", flat.alias("a"), seen.alias("b"))
    pick = lambda k: F.when(F.col("b").isNull() | (F.abs(F.col(f"a.{k}") - F.col(f"b.{k}")) < 1e-6), F.round(F.col(f"a.{k}"), 6))
    return both.select("c_custkey", pick("x").alias("lon"), pick("y").alias("lat"))


@query("g7_caps", f"WITH {BOXES} SELECT k, f, TRUE AS holds, x1 < 60 AND x0 > -40 AND y0 > -40 AND y1 < 60 AS near FROM boxes WHERE (x1 < 60 AND x0 > -40 AND y0 > -40 AND y1 < 60) OR (x0 > 130 AND abs(y0) < 30)")
def _(s, d):
    """All corners of a box lie in its cap; boxes near the middle of a view may show, those on the far side not."""
    b = derived.boxes(s, d).where("(x1 < 60 AND x0 > -40 AND y0 > -40 AND y1 < 60) OR (x0 > 130 AND abs(y0) < 30)")
    line = b.select("k", "f", "x0", "y0", G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("g")).withColumn("c", G.cap(F.col("g")))
    return line.select("k", "f", (G.distance(F.col("c.x"), F.col("c.y"), F.col("x0"), F.col("y0")) <= F.col("c.radius") + 1e-12).alias("holds"), G.cap_in_view(F.col("c"), F.lit(-10.0), F.lit(10.0)).alias("near"))


@query("g8_fitted_zoom", f"WITH {BOXES} SELECT k, f, round(greatest(1.1, least(18, least(1000 * 0.76 / ((x1 - x0) * 3.0), 540 * 0.74 / ((y1 - y0) * 3.0)))), 6) AS zoom FROM boxes")
def _(s, d):
    w, h = (F.col("x1") - F.col("x0")) * 3.0, (F.col("y1") - F.col("y0")) * 3.0
    return derived.boxes(s, d).select("k", "f", F.round(G.fitted_zoom(F.lit(1000), F.lit(640), w, h, F.lit(100)), 6).alias("zoom"))


@query(
    "p21_centres",
    f"""WITH {BOXES}, {NOW}, v AS (SELECT tier, greatest(1, a) AS w, radians(x0) AS l, radians(y0) AS p FROM now), s AS (SELECT tier, sum(w * cos(p) * cos(l)) AS x, sum(w * cos(p) * sin(l)) AS y, sum(w * sin(p)) AS z FROM v GROUP BY tier)
 SELECT tier, round(degrees(atan2(y, x)), 6) AS lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS lat FROM s""",
)
def _(s, d):
    centre = G.weighted_centre(F.lit(True), F.col("x0"), F.col("y0"), F.col("a"))
    return now(s, d).groupBy("tier").agg(centre.alias("c")).select("tier", F.round("c.x", 6).alias("lon"), F.round("c.y", 6).alias("lat"))


@query("p20_winding", f"WITH {BOXES} SELECT k, f, round(-1.0 * (x1 - x0) * (y1 - y0), 6) AS area FROM boxes")
def _(s, d):
    """Rings that hold more than half of the sphere are turned, so that a box runs clockwise whichever way it came."""
    box = G.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    either = F.when(F.col("k") % 2 == 0, box).otherwise(G.mapped(box, F.reverse))
    return derived.boxes(s, d).select("k", "f", F.round(G.ring_area(G.rewound(either)[0][0]), 6).alias("area"))


@query("g3_parts", f"WITH {BOXES} SELECT k, f, CAST(i AS INTEGER) AS part, round(CASE i WHEN 0 THEN 0.75 ELSE 1.0 END * (x1 - x0) * (y1 - y0), 6) AS area FROM boxes, range(2) p(i)")
def _(s, d):
    two = F.concat(F.col("shape"), G.rectangle(F.col("x0") + 50, F.col("y0"), F.col("x1") + 50, F.col("y1")))
    return ells(s, d).select("k", "f", F.posexplode(two).alias("part", "polygon")).select("k", "f", "part", F.round(G.planar_area(F.array("polygon")), 6).alias("area"))
