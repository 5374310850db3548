"""Ranked search: texts are folded once, and only hits are grouped."""

from tempora.operators import search


def test_texts_are_folded_once(spark):
    names = spark.createDataFrame([(1, "Réd bolt"), (1, "red  BOLT"), (2, "old red bolt"), (3, "bolt, red"), (4, "nut"), (5, "")], "key long, name string")
    aliases = spark.createDataFrame([(1, "red bolt"), (2, "Red Bolt!"), (4, "red bolts"), (5, None)], "key long, name string")
    facts = spark.createDataFrame([(k, f"n{k}", 1.0, True) for k in range(1, 6)], "key long, name string, peak double, active boolean")
    found = search.ranked(names, aliases, facts, "red bolt")
    assert [(r.key, r.score, r.alias) for r in found.collect()] == [(1, 0.0, None), (2, 0.25, "red bolt"), (4, 1.25, "red bolts"), (3, 3.0, None)]
    assert search.ranked(names, aliases, facts, "").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^\p{L}\p{N}]+") <= 12, plan.count(r"[^\p{L}\p{N}]+")
