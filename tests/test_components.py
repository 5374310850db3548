"""Components of links, and consolidation over nodes instead of claims."""

import random

from tempora.operators import consolidation, identity
from test_consolidation import one_after_another


def smallest_reached(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in found:
                found[n] = start
                todo += near[n]
    return found


def watched(monkeypatch, module):
    seen = []
    real = module.written

    def write(df, name):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), out := real(df, name), out.count()))
        return out

    monkeypatch.setattr(module, "written", write)
    return seen


def test_components_tell_no_table_to_all_tasks(spark, monkeypatch):
    seen = watched(monkeypatch, identity)
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(300, 300 - k) for k in range(1, 30)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)] + [(7, 7)]
    got = {r.node: r.component for r in identity.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == smallest_reached(links)
    assert not any("BroadcastHashJoin" in plan for _, plan, *_ in seen)
    left = [n for name, _, _, n in seen if name == "links"]
    assert left[-1] == 0 and left[0] > 3 * sum(left[1:])


def test_claims_of_one_person_are_one_node(spark, monkeypatch):
    seen = watched(monkeypatch, consolidation)
    rows = [(f"{p:03}-{i}", "a", f"n{p}", "xyz"[i % 3], f"name{p}") for p in range(50) for i in range(12)] + [("900", "a", "n900", "x", "name7"), ("901", "a", None, "x", "name8")]
    got = {r.id: r.component for r in consolidation.consolidated(spark.createDataFrame(rows, "id string, block string, person string, source string, name string")).collect()}
    assert [n for name, _, _, n in seen if name == "sets"] == [2]  # name8; name7 is given to two persons by x
    assert got["900"] == "900" and got["901"] == "008-0" and got["008-7"] == "008-0" and len(set(got.values())) == 51


def test_several_blocks_and_persons_unknown(spark):
    r = random.Random(11)
    rows = []
    for i in range(150):
        p = r.choice([f"wd:{r.randrange(15)}", f"n{r.randrange(30)}", None])
        rows += [(i, r.choice(["a", "a", "a", "b"]), p, r.choice("xyz"), r.choice([None, f"name{r.randrange(40)}"])) for _ in range(r.randint(1, 2))]
    got = consolidation.consolidated(spark.createDataFrame(rows, "id long, block string, person string, source string, name string")).collect()
    told = {(b, n) for _, b, p, _, n in rows if p}  # a name without any person joins nothing
    assert {x.id: x.component for x in got} == one_after_another([(*row[:4], row[4] if (row[1], row[4]) in told else None) for row in rows]) and len(got) == 150
