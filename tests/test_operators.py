"""Facts on small fixtures."""

from pyspark.sql import functions as F

from tempora.functions import scalars as S
from tempora.operators import temporal

RECORDS = [("rome", "Roman Republic", -500, -28, 100), ("rome", "Roman Republic", -27, 5, 200), ("roman", "Roman Empire", 6, 400, 1000), ("gap", "Restored State", 1, 10, 10), ("gap", "Restored State", 30, 40, 10)]


def records(spark, rows=RECORDS):
    return spark.createDataFrame(rows, "k string, n string, f int, t int, a long")


def test_snapshots(spark):
    at = lambda y: sorted((r.a for r in temporal.active(records(spark), y).collect()), reverse=True)
    assert at(-28) == [100] and at(-27) == [200] and at(6) == [1000, 10]


def test_nearest_takes_the_earlier_of_two(spark):
    years = spark.createDataFrame([(-20,), (-10,), (1,), (100,)], "year int")
    got = {r.year: r.nearest for r in temporal.nearest(spark.createDataFrame([(-15,), (0,), (-900,), (5000,)], "year int"), years).collect()}
    assert got == {-15: -20, 0: 1, -900: -20, 5000: 100}


def test_interpolation(spark):
    series = spark.createDataFrame([("log", 100, 100), ("log", 200, 10000), ("lin", 0, 0), ("lin", 100, 100)], "key string, year int, value long")
    probes = spark.createDataFrame([("log", 150), ("log", 90), ("log", 300), ("lin", 50)], "key string, at int")
    got = {(r.key, r.at): round(r.value, 6) for r in temporal.interpolate(series, probes).collect()}
    assert got == {("log", 150): 1000, ("log", 90): 100, ("log", 300): 10000, ("lin", 50): 50}


def test_presence(spark):
    series = spark.createDataFrame([("a", 0, 1), ("a", 300, 1), ("b", 0, 1), ("b", 301, 1)], "key string, year int, value long")
    probes = spark.createDataFrame([("a", 100), ("a", 350), ("a", 351), ("b", 100), ("b", 301)], "key string, at int")
    got = {(r.key, r.at): r.shown for r in temporal.present(series, probes).collect()}
    assert got == {("a", 100): True, ("a", 350): True, ("a", 351): False, ("b", 100): False, ("b", 301): True}


def test_map_changes(spark):
    rows = [("old", 1, 9, 100000), ("old", 10, 19, 40000), ("old", 20, 30, 41000), ("gone", 1, 9, 5000), ("gone", 25, 30, 5000), ("last", 1, 9, 5000), ("new", 10, 30, 60000)]
    df = spark.createDataFrame([(k, k, f, t, a) for k, f, t, a in rows], "k string, n string, f int, t int, a long")
    got = {r.k: (r.kind, r.delta, r.returns, r.last_mapped) for r in temporal.map_changes(df, 9, 15).collect()}
    assert got == {"old": ("changed", -60000, None, None), "gone": ("gone", -5000, 25, 9), "last": ("gone", -5000, None, 9), "new": ("first", 60000, None, None)}


def test_years_from_text(spark):
    rows = [("3,400 B.C.E.", -3400), ("BCE 1200", -1200), ("14,53", None), ("100 AD BCE", None), ("0", None), ("476", 476), ("−44", -44)]
    got = spark.createDataFrame(rows, "s string, y int").select("y", S.parsed_year(F.col("s")).alias("got")).collect()
    assert all(r.y == r.got for r in got), got


def test_match_scores(spark):
    rows = [("Roman Empire", "roman empire", 0.0), ("Roman Empire", "roman", 1.0), ("Holy Roman Empire", "roman", 2.0), ("Empire of the Romans", "romans empire", 3.0), ("Ottoman State", "ottomans", 3.5), ("Ming", "roman", None)]
    got = spark.createDataFrame(rows, "c string, n string, want double").select("want", S.match_score(F.col("c"), F.col("n")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_palette_is_fnv1a(spark):
    def fnv(s):
        h = 2166136261
        for i in range(0, len(b := s.encode("utf-16-be")), 2):
            h = ((h ^ int.from_bytes(b[i : i + 2], "big")) * 16777619) & 0xFFFFFFFF
        return h % 10

    names = ["Rome", "Café State", "明", ""]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.palette_index(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == {n: fnv(n) for n in names}
