"""Peers by person, or by a name that one person has."""

from tempora.operators import identity

ROW = "id string, lineage string, polity string, person long, name string, role string, `from` int, `to` int"


def test_a_frequent_name_makes_no_pairs(spark):
    many = lambda at, lineage: spark.range(at, at + 60_000).selectExpr("cast(id as string) id", f"'{lineage}' lineage", "'p' polity", "id person", "'n' name", "'r' role", "1 `from`", "2 `to`")
    few = spark.createDataFrame([("a", "x", "p", 1, "m", "r", 1, None), ("b", "x", "p", 2, "k", "r", 1, 2), ("c", "x", "p", 3, "k", "r", 1, 2)], ROW)
    there = spark.createDataFrame([("d", "y", "p", 9, "m", "r", 2, 3), ("e", "y", "p", None, "m", "r", 2, 3), ("f", "y", "p", 3, "k", "r", 2, 3), ("g", "y", "p", 8, "m", "r", None, 0), ("h", "x", "p", 7, "m", "r", 1, 1)], ROW)
    got = identity.peers(many(1000, "x").unionByName(few), many(100_000, "y").unionByName(there)).collect()
    assert {tuple(r) for r in got} == {("a", "d", "name"), ("a", "e", "name"), ("b", "f", "name"), ("c", "f", "person")} and len(got) == 4
