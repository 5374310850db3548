"""The stored index of names against a search that scores every name."""

import random

from pyspark.sql import functions as F

from tempora.operators import nameindex, search


def test_searches_from_the_index(spark, tmp_path):
    r = random.Random(1)
    words = ["otto", "ötto", "the great", "henry", "henryson", "a", "is", "kingdom", "kingdoms", "république", "of", "Bavaria", "bavarian", "x1", "Łódź", "ab"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 4)))) for i in range(300)] + [(1, "otto the great"), (2, None), (3, ""), (4, "otto " * 800)]
    names = spark.createDataFrame(rows, "key long, name string").repartition(3)
    aliases = spark.createDataFrame([(k + 5, n) for k, n in rows[:200]] + rows[:20], "key long, name string")
    facts = spark.createDataFrame([(i, f"n{i}", float(i % 7), i % 2 == 0) for i in range(310)], "key long, name string, peak double, active boolean")
    path = str(tmp_path / "index")
    nameindex.build(names, aliases, path)
    for text in ["otto", "Otto the Great", "great otto", "kingdomly bavariat", "a", "ab", "République", "zz", "", "  ", "henrysong", "x1 is", "lodz"]:
        got = [tuple(x) for x in nameindex.ranked(spark, path, facts, text, 50).collect()]
        assert got == [tuple(x) for x in search.ranked(names, aliases, facts, text, 50).collect()], text


def test_a_search_reads_one_folder(spark, tmp_path):
    names = spark.createDataFrame([(i, f"name {i} of {i * i}") for i in range(500)], "key long, name string")
    nameindex.build(names, names.where("false"), path := str(tmp_path / "index"))
    found = nameindex.candidates(spark, path, "2500 name")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(run,250)" in plan
    assert {x.key for x in found.collect()} >= {50}
    assert len({x[0].rsplit("/", 2)[1] for x in found.select(F.input_file_name()).collect()}) == 1
    assert nameindex.candidates(spark, path, "qqq name") is None


def test_ruler_index(spark, tmp_path):
    claims = spark.createDataFrame([(1, "Otto", ["Odo", "Ottone"], 936), (2, "Ottokar", None, None), (3, "Anna", ["the otto"], 900), (4, None, [], 5)], "claim long, name string, aliases array<string>, `from` int")
    named = nameindex.ruler_names(claims)
    nameindex.build(named, named.where("false"), path := str(tmp_path / "index"))
    found = nameindex.rulers(spark, path, claims.select("claim", "from"), "otto").collect()
    assert [(x.claim, x.score) for x in found] == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert nameindex.rulers(spark, path, claims, "").count() == 0 and nameindex.rulers(spark, path, claims, "zzz").count() == 0
