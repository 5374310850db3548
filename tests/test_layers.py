"""Layer readers, outlines, names, curation and the stream, on small fixtures."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.functions import names
from tempora.functions import scalars as S
from tempora.operators import curation, resolve, views
from tempora.sources import adapters, layers, outline, publication, stores
from tempora.streaming import snapshots

SQUARE = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]


def collection(path, features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}))
    return str(path)


def test_registry_and_records(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("sources:\n- id: a\n  title: A\n  tier: 1\n  authority: {years: [-50, 20], bbox: [0, 1, 2, 3]}\n- id: b\n  tier: 2\n  role: extent\n")
    got = {r.id: r for r in layers.registry(spark, str(tmp_path / "r.yaml")).collect()}
    assert (got["a"].lo, got["a"].hi, got["a"].bx1, got["b"].lo, got["b"].role) == (-50, 20, 2.0, None, "extent")
    poly = {"type": "Polygon", "coordinates": [*SQUARE, HOLE]}
    many = {"type": "MultiPolygon", "coordinates": [SQUARE, [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}
    path = collection(tmp_path / "c.geojson", [({"Name": "X", "FromYear": 1, "ToYear": 9}, poly), ({"Name": "Y", "FromYear": 5, "ToYear": 9}, many), ({"Name": "Z", "FromYear": 1, "ToYear": 9}, {"type": "Point", "coordinates": [1, 2]}), ({"Name": "W", "FromYear": 8, "ToYear": 9}, poly), ({"Name": "N", "FromYear": 1, "ToYear": 9}, None)])
    found = layers.polygon_records(spark, path, "c", 6, [])
    assert sorted((r.name, r.f, r.t, round(r.area, 6)) for r in found.withColumn("area", G.planar_area(F.col("shape"))).collect()) == [("X", 1, 9, 15.0), ("Y", 5, 9, 16.5)]
    assert layers.feature_table(spark, path, layers.RECORD) is layers.feature_table(spark, path, layers.RECORD)
    layer = collection(tmp_path / "u.geojson", [({"layer": "a"}, poly), ({"layer": "b"}, many)])
    union = lambda: sorted(round(r.area, 6) for r in layers.union_layer(spark, layer).select(G.planar_area(F.col("shape")).alias("area")).collect())
    assert union() == [0.5, 16.0]
    collection(tmp_path / "u.geojson", [({"layer": "a"}, poly)])
    assert union() == [15.0]  # the file has changed


def test_geojson_goes_out_as_it_came(spark):
    shapes = [{"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPolygon", "coordinates": [SQUARE]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, None]
    rows = spark.createDataFrame([(i, None if g is None else json.dumps(g)) for i, g in enumerate(shapes)], "id int, g string")
    out = [json.loads(r.value) for r in adapters.as_collection(rows, "g").collect()]
    assert [f["geometry"] for f in sorted(out, key=lambda f: f["properties"]["id"])] == shapes
    back = rows.select("id", layers.geojson_of(layers.shape_of(F.col("g"))).alias("j")).collect()
    assert json.loads(back[1].j)["coordinates"][0][0][1] == [4.0, 0.0] and back[0].j is None


def test_snapshots_countries_and_classes(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": SQUARE}
    for year in ("bc200", "100", "400"):
        collection(tmp_path / f"world_{year}.geojson", [({"NAME": f"S{year}"}, square), ({"NAME": " "}, square), ({"NAME": "P"}, {"type": "Point", "coordinates": [1, 1]})])
    assert sorted(r.year for r in layers.snapshot_index(spark, str(tmp_path)).collect()) == [-200, 100, 400]
    assert [(r.name, r.year) for r in layers.snapshot_records(spark, str(tmp_path), 250).collect()] == [("S100", 100)]
    assert layers.snapshot_records(spark, str(tmp_path), 900).count() == 0
    path = collection(tmp_path / "k.geojson", [({"ADMIN": "A", "ISO_A2": "-99", "ADM0_A3": "AAA"}, square), ({"ADMIN": "", "NAME": "B", "ISO_A2": "BB"}, square), ({"ADMIN": "Antarctica"}, square)])
    assert sorted((r.name, r.code) for r in layers.countries(spark, path).collect()) == [("A", "AAA"), ("B", "BB")]
    path = collection(tmp_path / "f.geojson", [({"featurecla": "River", "scalerank": 3}, square), ({"featurecla": "Lake", "scalerank": 1}, square), ({"featurecla": "Road", "scalerank": 0}, square)])
    rows = layers.classed_features(spark, path, ["River", "Lake"]).withColumn("a", G.ring_area(F.col("shape")[0][0])).collect()
    assert [(r.r, r.a) for r in rows] == [(1, -16.0), (3, -16.0)]


def test_tables_of_reigns(spark, tmp_path, monkeypatch):
    import pandas as pd

    pd.DataFrame({"ccode": [2, 2, 3], "idacr": ["A", "A", "B"], "leader": ["x", "y", "z"]}).to_stata(tmp_path / "a.dta", write_index=False)
    labels = spark.createDataFrame([(2, "A", "Aland")], "code int, idacr string, label string")
    rows = layers.stata_records(spark, str(tmp_path / "a.dta"), {"ccode": "code", "idacr": "idacr", "leader": "name"}, labels).collect()
    assert sorted((r.name, r.label) for r in rows) == [("x", "Aland"), ("y", "Aland"), ("z", None)]
    monkeypatch.setattr(layers, "STATA_ROWS", 2)
    assert layers.stata_rows(spark, str(tmp_path / "a.dta"), {"leader": "name"}).columns == ["name"] and layers.stata_rows(spark, str(tmp_path / "a.dta"), {"leader": "name"}).count() == 3
    with pytest.raises(Exception, match="two labels"):
        layers.stata_records(spark, str(tmp_path / "a.dta"), {"ccode": "code", "idacr": "idacr"}, labels.unionByName(labels.withColumn("label", F.lit("other")))).collect()
    rulers = spark.createDataFrame([("1", "x", 5, None, "joint rule"), ("1", "y", 5, 6, None)], "dynasty_id string, name string, `from` int, `to` int, note string")
    dynasties = spark.createDataFrame([("1", "D", None)], "dynasty_id string, dynasty string, branch string")
    assert {r.name: r["flags"] for r in layers.star_records(rulers, dynasties).collect()} == {"x": ["unknown-bound", "joint"], "y": []}
    with pytest.raises(Exception, match="no dynasty"):
        layers.star_records(rulers, dynasties.where("false")).collect()
    table = spark.createDataFrame([("George", "Kingdom of Greece", "1760-10-25", "c. 1820", 2)], "Monarch string, Kingdom string, `Start date` string, `End date` string, line int")
    r = layers.reign_rows(table).first()
    assert (r.rid, r.polity_key, r["from"].year, r["to"].approximate) == ("csv-row-2", "greece", 1760, True)
    (tmp_path / "r.bin").write_bytes(bytes([1, 2, 3, 4, 5, 6]))
    assert sorted(tuple(x) for x in layers.raster_cells(spark, str(tmp_path / "r.bin"), 3).collect()) == [(0, 0, 1), (0, 1, 4), (1, 0, 2), (1, 1, 5), (2, 0, 3), (2, 1, 6)]
    df = spark.range(3)
    layers.publish(df, str(tmp_path / "out"), "parquet")
    layers.checked(df, str(tmp_path / "out"))
    layers.publish(spark.range(4).select("id"), str(tmp_path / "out"), "parquet")
    layers.publish(df, str(tmp_path / "out"), "parquet")
    with pytest.raises(ValueError, match="stale"):
        layers.checked(spark.range(4), str(tmp_path / "out"))


def test_outline(spark):
    page = """<h2>One</h2><p>Text <b>bold</b><sup class="reference">[1]</sup> <span style="display: none">no</span>end<h3>Sub</h3><ul><li>a<ul><li><a href=x>in</a></ul><li>b</ul><h2>Two</h2><p>z<script>var</script>"""
    blocks = outline.outline(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "</li></ul><li>open")], "id long, html string"), "id", "html").collect()
    mine = [(b.kind, b.text, list(b.section)) for b in blocks if b.id == 1]
    assert mine == [("heading", "One", []), ("p", "Text bold end", ["One"]), ("heading", "Sub", ["One"]), ("li", "a", ["One", "Sub"]), ("li", "in", ["One", "Sub"]), ("li", "b", ["One", "Sub"]), ("heading", "Two", ["One", "Sub"]), ("p", "z", ["Two"])]
    assert [(b.text, b.depth, b.parent is not None) for b in blocks if b.kind == "li"] == [("a", 0, False), ("in", 1, True), ("b", 0, False), ("open", 0, False)]
    lines = spark.createDataFrame([("Otto the Great, 936–973",), ("936–973",), (None,)], "t string").select(outline.unlinked_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in lines] == ["Otto the Great", None, None]


def test_folding_equals_the_full_decomposition(spark):
    texts = ["Ærøskøbing", "ﬁn ĳ Ǆ", "Łódź Ångström", "ĆČÇ ẞ", "Ωμέγα Ἀθῆναι", "Ёлка й", "½ ①", "ＡＢＣ", "áb", ""]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.folded(F.col("t")).alias("f")).collect()}
    plain = lambda t: "".join(c if c.isalnum() else " " for c in "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) <= 0x36F).lower()).split()
    assert {t: f.split() for t, f in got.items()} == {t: plain(t) for t in texts} | {"½ ①": got["½ ①"].split()}


def test_name_variants(spark):
    of = {"Emperor Otto (Odo)": {"emperor otto odo", "emperor otto", "otto", "odo", "emperor odo"}, "Theodosios (Theodosius) II": {"theodosios theodosius ii", "theodosius ii", "theodosios ii"}}
    rows = spark.createDataFrame([(n,) for n in of], "n string").select("n", names.name_variants(F.col("n")).alias("v")).collect()
    for r in rows:
        assert of[r.n] <= set(r.v), (r.n, r.v)
    assert "theodosius" not in {v for r in rows for v in r.v if r.n.startswith("Theod")}


def test_name_variants_fold_a_name_once(spark):
    """Folding and splitting stand in the plan once, however many rules use what they give."""
    line = spark.createDataFrame([(None,), ("",), ("Ján) II (King",)], "n string").select(names.name_variants(F.col("n")).alias("v"))
    assert [r.v for r in line.collect()] == [None, [], ["ii jan king", "jan ii king", "janking"]]
    plan = line._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 8 and len(plan) < 100_000


def test_labels_and_days(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 4, 4), (1, 2, 3, 3, 6, 6), (1, 3, 4, 0, 8, 3), (1, 4, 5, 5, 7, 7), (2, 1, 0, 0, 1, 1)], "view int, ord int, x0 int, y0 int, x1 int, y1 int")
    assert sorted((r.view, r.ord) for r in views.label_claims(boxes).where("placed").collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    rows = [("a", 1, 0, 10), ("a", 2, 5, 20), ("a", 3, 10, 20), ("b", 1, None, 5), ("b", 2, 9, 10), ("c", 1, 0, 5), ("c", 2, None, 9), ("c", 3, 5, 6), ("c", 4, 5, 7)]
    df = spark.createDataFrame(rows, "sig string, ord int, from_day int, to_day int")
    assert sorted((r.sig, r.ord) for r in curation.distinct_days(df, ["sig"]).collect()) == [("a", 1), ("a", 3), ("b", 1), ("c", 1), ("c", 3)]


def test_crawl_ends_in_circles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "skip"), ("skip", "d")], "page string, target string")
    found = curation.crawled(spark.createDataFrame([("a",)], "page string"), links, "^.$", stores.written)
    assert sorted((r.page, r.depth) for r in found.collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_boxes_less_masks_keep_their_cells(spark):
    import random

    rng = random.Random(3)
    box = lambda i: (i, False, x := rng.randrange(9), y := rng.randrange(9), x + 1 + rng.randrange(6), y + 1 + rng.randrange(6))
    subjects, masks = [box(i) for i in range(40)], [box(i)[2:] for i in range(5)]
    cells = lambda b: {(x, y) for x in range(b[0], b[2]) for y in range(b[1], b[3])}
    covered = set().union(*(cells(m) for m in masks))
    got = resolve.remaining(spark.createDataFrame(subjects, "id int, protected boolean, x0 int, y0 int, x1 int, y1 int"), spark.createDataFrame(masks, "x0 int, y0 int, x1 int, y1 int"))
    want = {i: len(cells(b) - covered) for i, _, *b in subjects}
    assert {r.id: r.left for r in got.collect()} == {i: n for i, n in want.items() if n}


def test_stream_leaves_late_events_out(spark, tmp_path):
    from datetime import datetime

    (tmp_path / "in").mkdir()
    at = lambda day, n: [(datetime(2024, 1, day, 12), 7)] * n
    schema = "ts timestamp, user_id long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = snapshots.daily_counts(stream).writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in (at(1, 2), at(2, 3), at(9, 1), at(1, 5), at(20, 1)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    query.stop()
    assert sorted((r.day.day, r.n) for r in spark.table("daily").collect()) == [(1, 2), (2, 3), (9, 1)]


def test_a_failed_build_leaves_what_is_published(spark, tmp_path):
    folder = str(tmp_path / "site")
    bad = spark.range(6, numPartitions=3).withColumn("id", F.when(F.col("id") < 5, F.col("id")).otherwise(F.raise_error(F.lit("stopped")).cast("long")))
    with pytest.raises(FileNotFoundError):
        publication.published(spark, folder)
    publication.publish(spark.range(3), folder, "parquet")
    reader = publication.published(spark, folder)
    with pytest.raises(Exception, match="stopped"):
        publication.publish(bad, folder, "parquet")
    assert sorted(r.id for r in publication.published(spark, folder).collect()) == [0, 1, 2]
    publication.publish(spark.range(5), folder, "parquet")
    assert reader.count() == 3 and publication.published(spark, folder).count() == 5  # who began to read goes on with the old version
    assert len(publication.retired(spark, folder)) == 2 and publication.retired(spark, folder) == []
    assert publication.published(spark, folder).count() == 5


def test_only_changed_parts_are_built(spark, tmp_path):
    folder, ran = str(tmp_path / "site"), []

    def part(name, n):
        def build():
            ran.append(name)
            return spark.range(n)

        return build

    first = {"a": ("1", part("a", 2)), "b": ("1", part("b", 3))}
    assert publication.published_parts(spark, folder, first) == ["a", "b"]
    assert publication.published_parts(spark, folder, first) == [] and ran == ["a", "b"]
    assert publication.published_parts(spark, folder, {"a": ("2", part("a", 7)), "b": ("1", part("b", 9))}) == ["a"]
    assert [publication.published(spark, folder, p).count() for p in "ab"] == [7, 3]
    with pytest.raises(ZeroDivisionError):  # a is built and b is not: both stay as they were
        publication.published_parts(spark, folder, {"a": ("3", part("a", 1)), "b": ("2", lambda: 1 / 0)})
    assert [publication.published(spark, folder, p).count() for p in "ab"] == [7, 3]
    publication.published_parts(spark, folder, {"b": ("1", part("b", 9))})
    assert set(publication.manifest(spark, folder)) == {"b"}
