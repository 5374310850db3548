"""Statements from JSON, with values of other kinds, missing parts and texts that are no JSON."""

import json

from tempora.sources import statements as T


def time(y, precision=9, **more):
    return {"datavalue": {"value": {"time": f"{'-' if y < 0 else '+'}{abs(y):04d}-00-00T00:00:00Z", "precision": precision, "before": 0, "after": 0, "calendarmodel": "http://x/entity/Q1985727"} | more}}


def item(q):
    return {"datavalue": {"value": {"id": q}}}


def held(office, starts, ends, rank="normal", **qualifiers):
    q = {"P580": [time(y) if isinstance(y, int) else y for y in starts], "P582": [time(y) if isinstance(y, int) else y for y in ends]}
    return {"rank": rank, "mainsnak": item(office), "qualifiers": {k: v for k, v in q.items() if v} | qualifiers}


def test_statements(spark, tmp_path):
    one = {"id": "Q1", "labels": {"en": {"value": "Otto"}}, "claims": {"P39": [
        held("Q10", [936], [973]), held("Q10", [936, 940], [973]), held("Q11", [900], [950], P1480=[item("Q5727902")]), held("Q11", [900], [950], P1480=[item("Q9")]), held("Q12", [800], [950]), held("Q12", [950], [800]),
        held("Q13", [1], [2], P518=[item("Q2")]), held("Q13", [1], [2], "deprecated"), held("Q14", [time(1, 7)], [2]), held("Q14", [time(1, before=1)], [2]), held("Q15", [-5], [3]), {"mainsnak": {"snaktype": "novalue"}}, None,
        held("Q16", [5, time(9, 7)], [8], P5102=[item("Q2")]), held("Q16", [5], [8], P1552=[item("Q18912752"), {"datavalue": {"value": "text"}}]), held("Q16", [5, 6], [8], P1480=[item("Q18122778")]),
    ], "P18": [{"mainsnak": {"datavalue": {"value": "a.jpg"}}}]}}
    two = {"entities": {"Q2": {"claims": {"P39": [held("Q10", [973], [983])], "P18": [{"mainsnak": {"datavalue": {"value": "b.jpg"}}}]}}, "Q3": {"claims": {}}, "Q4": {"missing": ""}}}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(one), "{broken", "", "[]", json.dumps(two)]))
    told = T.statements(T.entities(T.read(spark, str(tmp_path / "a.jsonl"))), ["P39", "P18"])
    rows = told.collect()
    assert {(r.entity, r.property): 0 for r in rows}.keys() == {("Q1", "P39"), ("Q1", "P18"), ("Q2", "P39"), ("Q2", "P18")}
    assert sum(r.entity == "Q1" and r.property == "P39" for r in rows) == 15 and {r.label for r in rows if r.entity == "Q1"} == {"Otto"}
    terms = T.terms(told.where("property = 'P39'")).collect()
    assert sorted((r.entity, r.ord, r.target, r.f, r.t, r.precision) for r in terms) == [("Q1", 0, "Q10", 936, 973, "year"), ("Q1", 2, "Q11", 900, 950, "approximate"), ("Q1", 10, "Q15", -5, 3, "year"), ("Q1", 14, "Q16", 5, 8, "year"), ("Q2", 0, "Q10", 973, 983, "year")]
    assert sorted(tuple(r) for r in T.doubted(told).collect()) == [("Q1", "Q16", 5, 8), ("Q1", "Q16", 5, 8)]
    assert T.statements(T.entities(T.read(spark, str(tmp_path / "a.jsonl")).where("false")), ["P39"]).count() == 0
