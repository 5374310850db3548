"""Readers, dates and identity operators on small fixtures."""

import json

from pyspark.sql import functions as F

from tempora.functions import dates
from tempora.operators import identity
from tempora.sources import adapters


def test_date_ranges(spark):
    want = {"15 January – 16 April 69": (69, 69), "27 BC – 14 AD": (-27, 14), "958/64–985/6": None, "1448-1456": (1448, 1456), "100–90 BC": (-100, -90), "1200 – 1500": None, "c. 1100 to 1110": (1100, 1110), "1990 – present": None, "": None,
            "8 June 68 – 15 January 69": (68, 69), "fl. c. 2120 – c. 2119 BC": None, "247–211 B.C.": (-247, -211), "(aged 9) 10-c. 20 [note 1-2]": (10, 20), "1890s – 1900": None, "12345 to 1400": None, "1 – 2 – 3": None, "0 – 5": None, "20 – 10": None}
    rows = spark.createDataFrame([(t,) for t in want] + [(None,)], "t string").select("t", dates.date_range(F.col("t")).alias("r")).collect()
    assert {r.t: r.r and (r.r["from"], r.r["to"]) for r in rows} == want | {None: None}
    assert {r.t: r.r.precision for r in rows if r.r}["c. 1100 to 1110"] == "approximate"


def test_episodes_and_bounds(spark):
    df = spark.createDataFrame([("1448, 1456–1462, x, 1476",)], "t string")
    assert [(e["episode"], e["from"], e["to"]) for e in df.select(dates.episodes(F.col("t")).alias("e")).first().e] == [(1, 1448, 1448), (2, 1456, 1462), (4, 1476, 1476)]
    bound = spark.createDataFrame([("1760-10-25",), ("c. 900",), ("-44?",), ("12th century",), (None,)], "t string").select(dates.date_bound(F.col("t")).alias("b"))
    assert [(r.b.year, r.b.precision, r.b.approximate, r.b.uncertain) for r in bound.collect()] == [(1760, "day", False, False), (900, "year", True, False), (-44, "year", False, True), (None, "unknown", False, False), (None, "unknown", False, False)]


def test_offices_and_placeholders(spark):
    df = spark.createDataFrame([("Padisah", "List of sultans", "Vacant"), ("King of Kings (1 - 2)", "Monarchs and regents", "Anne"), ("Monarch of X", "Others", "Military junta")], "role string, section string, name string")
    got = df.select(dates.office_class(F.col("role")), dates.inferred_office(F.col("section"), F.lit(""), F.lit("none")), dates.names_nobody(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("emperor", "Sultan", True), ("shahanshah", "Sovereign", False), ("*monarch", "none", True)]


def test_tables_expand_spans(spark):
    html = "<table><tr><th rowspan=2>a<th colspan='2'>b</tr><tr><td>c<td>d<table><tr><td>in</table></tr></table>"
    got = adapters.table_rows(spark.createDataFrame([(1, html), (2, None), (3, "<table>")], "id long, html string"), "id", "html").collect()
    assert sorted((r.id, r.table, r.row, r.cells) for r in got) == [(1, 0, 0, ["in"]), (1, 1, 0, ["a", "b", "b"]), (1, 1, 1, ["a", "c", "d"])]


def test_rule_file_geojson_and_receipts(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('# note\n\n{"id":"a"}\n{"id":"b","status":"draft"}\n{"id":"c","status":"active"}\n')
    assert [r.id for r in adapters.rule_lines(spark, str(tmp_path / "r.jsonl"), "id string, status string").collect()] == ["a", "c"]
    shape = {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"Name": "x", "FromYear": -3}, "geometry": shape}]}))
    found = adapters.features(spark, str(tmp_path / "f.geojson"), "Name:string,FromYear:int")
    assert json.loads(found.first().geometry) == shape
    assert json.loads(adapters.as_collection(found, "geometry").first().value) == {"type": "Feature", "properties": {"Name": "x", "FromYear": -3}, "geometry": shape}
    prints = adapters.fingerprints(adapters.read(spark, "files", str(tmp_path / "r.jsonl"))).withColumn("path", F.lit("r.jsonl"))
    told = spark.createDataFrame([("r.jsonl", "0"), ("gone", "1"), ("../up", "1"), ("two", "1"), ("two", "2")], "path string, sha256 string")
    assert {r.path: r.fault for r in adapters.receipt_faults(told, prints).collect()} == {"r.jsonl": "changed", "gone": "missing", "../up": "outside", "two": "conflicting"}
    assert adapters.read(spark, "lines", "x") is None


def test_wide_long_lines_and_snapshots(spark):
    wide = spark.createDataFrame([("u", "10", "x", "0")], "city string, BC_100 string, AD_1 string, AD_2 string")
    assert [tuple(r) for r in adapters.unpivoted(wide, ["city"]).collect()] == [("u", -100, 10.0)]
    rows = spark.createDataFrame([("World", "5", "7"), ("World", "x", "7"), ("Else", "5", "7")], "entity string, year string, value string")
    assert [tuple(r) for r in adapters.long_series(rows, "World").collect()] == [(5, 7.0)]
    texts = spark.createDataFrame([(1, "L1: a\nno\nL20:  b c")], "id int, text string")
    assert sorted((r.line, r.text) for r in adapters.numbered_lines(texts, "id").collect()) == [(1, "a"), (20, "b c")]
    names = spark.createDataFrame([("x/world_bc200.geojson",), ("world_1500.geojson",), ("other",)], "p string")
    assert [r[0] for r in names.select(adapters.snapshot_year(F.col("p"))).collect()] == [-200, 1500, None]


def test_identity_edges(spark):
    moves = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s")], "page string, target string")
    pages = spark.createDataFrame([(p,) for p in "abcxys"], "page string")
    assert {r.page: r.target for r in identity.redirected(pages, moves).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "y": None, "s": "s"}
    rows = spark.createDataFrame([("s1", "wd:Q1", "Anna"), ("s2", "p7", "Anna"), ("s1", "wd:Q2", "Bea"), ("s2", "wd:Q3", "Bea"), ("s3", "p9", None)], "source string, person string, name string")
    got = {r.person: r.component for r in identity.consolidated(rows).collect()}
    assert got["p7"] == got["wd:Q1"] and len({got["wd:Q2"], got["wd:Q3"]}) == 2 and got["p9"] == "p9"
    assert identity.components(rows.limit(0).selectExpr("1L a", "2L b")).count() == 0
