"""Consolidation, office groups and routes against plain evaluations of their rules one row after another."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tempora.functions.names import EFFECTIVE
from tempora.operators import consolidation


def one_after_another(rows):
    """Union-find over sets in their order; a set with two external identities is refused."""
    sets = defaultdict(set)
    sources = defaultdict(set)
    for i, block, person, source, name in rows:
        if person is not None:
            sets[block, 0, person].add(i)
        if name is not None:
            sets[block, 1, name].add(i)
            sources[block, name, source].add(person)
    unsure = {(b, n) for (b, n, _), people in sources.items() if len(people - {None}) > 1}
    todo = [(kind, min(ids), shared, block, ids) for (block, kind, shared), ids in sets.items() if kind == 0 or (block, shared) not in unsure]
    at = {r[0]: r[0] for r in rows}
    wd = {r[0]: {r[2]} if (r[2] or "").startswith("wd:") else set() for r in rows}

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for *_, ids in sorted(todo, key=lambda t: (t[3], *t[:3])):
        roots = {find(i) for i in ids}
        external = set().union(*(wd[r] for r in roots))
        if len(external) <= 1:
            to = min(roots)
            for r in roots:
                at[r] = to
            wd[to] = external
    return {i: find(i) for i in at}


@pytest.mark.parametrize("seed", range(4))
def test_consolidation(spark, seed):
    r = random.Random(seed)
    person = {}
    rows = []
    for i in range(120):
        block = r.choice(["a", "a", "b"])
        p = person.setdefault(i, r.choice([f"wd:{r.randrange(12)}", f"n{r.randrange(25)}"]))
        rows += [(i, block, p, r.choice("xyz"), f"name{r.randrange(30)}") for _ in range(r.randint(1, 2))]
        if r.random() < 0.1:
            rows.append((i, block, p, "x", None))
    df = spark.createDataFrame(rows, "id long, block string, person string, source string, name string").repartition(3)
    got = {x.id: x.component for x in consolidation.consolidated(df).collect()}
    want = one_after_another(rows)
    assert got == want
    assert len(set(want.values())) < 100
    externals = defaultdict(set)
    for i, _, p, *_ in rows:
        if p.startswith("wd:"):
            externals[got[i]].add(p)
    assert max(map(len, externals.values())) == 1


def test_a_refused_set_leaves_what_was_joined(spark):
    rows = [(1, "a", "wd:1", "x", "Otto"), (2, "a", "n2", "y", "Otto"), (3, "a", "n2", "y", "Odo"), (4, "a", "wd:4", "x", "Odo"), (5, "a", "wd:4", "x", "Otho"), (6, "b", "wd:1", "x", "Otto")]
    df = spark.createDataFrame(rows, "id long, block string, person string, source string, name string")
    assert {x.id: x.component for x in consolidation.consolidated(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert consolidation.consolidated(df.where("false")).count() == 0


OFFICES = ["King", "Emperor", "King of Kings", "Monarch", "Head of state", "Head of government", "Prime minister", "President", "Duke of York", "Duke", "Count", EFFECTIVE, "Ruler", "Prime minister of X", None]


def plain_compatible(a, b):
    royal = lambda v: any(v == w or v.startswith(w + " ") for w in consolidation.ROYAL)
    general = {
        "*effective": lambda v: True, "*monarch": lambda v: royal(v) or v in ("*head of state", "*head of government"), "*head of state": lambda v: royal(v) or v.startswith("president"),
        "*head of government": lambda v: royal(v) or v.startswith(consolidation.GOVERNING),
    }
    covers = lambda g, v: (g in general and general[g](v)) or v.startswith((g.lstrip("*") + " of ", g.lstrip("*") + " in "))
    return a == b or covers(a, b) or covers(b, a)


def test_office_groups(spark):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.choice("pq"), r.choice([1, 2, None]), 5, r.choice(OFFICES[:-1]), r.choice([None, None, None, "d1", "d2"])) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, polity string, person string, `from` int, `to` int, role string, days string").repartition(3)
    pairs = spark.createDataFrame([("a", "Count", "Duke")], "polity string, one string, other string")
    office = {x.role: x.o for x in df.select("role", consolidation.office_of(F.col("role")).alias("o")).distinct().collect()}
    together = lambda x, y: (plain_compatible(office[x[5]], office[y[5]]) or (x[1] == "a" and {x[5], y[5]} == {"Count", "Duke"})) and not (x[6] and y[6] and x[6] != y[6])
    tenures = defaultdict(list)
    for x in rows:
        tenures[x[1:5]].append(x)
    want = set()
    for members in tenures.values():
        several = len({x[6] for x in members} - {None}) > 1
        groups = []
        for x in sorted(members, key=lambda x: (office[x[5]].startswith("*"), x[0])):
            if several and x[6] is None:
                want.add((x[0],))
                continue
            fit = next((g for g in groups if all(together(y, x) for y in g)), None)
            if fit is None:
                groups.append([x])
            else:
                fit.append(x)
        want |= {tuple(sorted(x[0] for x in g)) for g in groups}
    placed = defaultdict(list)
    for x in consolidation.office_groups(df, pairs).collect():
        placed[(x.polity, x.person, x["from"], x.to, x.clique) if x.clique is not None else x.id].append(x.id)
    assert {tuple(sorted(v)) for v in placed.values()} == want
    dated = {x[0] for x in rows if x[3] is not None}
    assert {tuple(x.ids) for x in consolidation.merges(df, pairs).collect()} == {g for g in want if len(g) > 1 and set(g) <= dated}


def test_routes(spark):
    r = random.Random(2)
    year = lambda: r.choice([1000, 1003, 1005, 1008])
    rows, peers = [], []
    for i in range(400):
        f = r.choice([None, *[year()] * 9])
        t = r.choice([None, *[(f or 1000) + r.choice([0, 2, 4])] * 9])
        rows.append((i, r.randrange(90), r.random() > 0.05, r.choice(["year", "day"]), f, t, r.random() < 0.1, r.random() < 0.4))
        for k in range(r.choice([0, 0, 0, 1, 2])):
            peers.append((i, f"p{i}.{k}", r.choice([f, f, f, f, None, year()]), r.choice([t, t, t, None]), r.choice(["year", "day"])))
    df = spark.createDataFrame(rows, "id long, component long, valid boolean, precision string, `from` int, `to` int, ambiguous boolean, external boolean").repartition(3)
    there = spark.createDataFrame(peers, "id long, peer string, `from` int, `to` int, precision string")
    got = {x.id: (x.route, x.existing, x.checks_only) for x in consolidation.routed(df, there).collect()}

    of = defaultdict(list)
    for p in peers:
        of[p[0]].append(p)
    want, groups = {}, defaultdict(list)
    for row in rows:
        i, component, valid, precision, f, t, ambiguous, external = row
        mine = of[i]
        equal = [p for p in mine if (p[2], p[3]) == (f, t)]
        existing = sorted({p[1] for p in equal})
        against = any((p[2] is not None and f is not None and p[2] != f) or (p[3] is not None and t is not None and p[3] != t) for p in mine)
        if not valid:
            route = "rejected"
        elif (f is None or t is None) and mine:
            route = "candidateDuplicate"
        elif against:
            route = "conflict"
        elif any(p[4] == precision for p in equal):
            route = "matched"
        elif equal:
            route = "duplicate"
        elif ambiguous:
            route = "candidateDuplicate"
        else:
            route = "import"
        want[i] = (route, existing, route == "matched" and bool(equal))
        if route == "import" or (route == "matched" and not equal):
            groups[component].append((*row, route))
    for group in groups.values():
        dated = [x for x in group if None not in x[4:6]]
        for x in group:
            f, t = x[4:6]
            if f is None or t is None:
                if dated:
                    want[x[0]] = ("candidateDuplicate", want[x[0]][1], want[x[0]][2])
                continue
            others = {y[4:6] for y in dated} - {(f, t)}
            if any(f == a or max(f, a) < min(t, b) for a, b in others):
                want[x[0]] = ("conflict", want[x[0]][1], want[x[0]][2])
                continue
            first = min((y for y in dated if y[4:6] == (f, t) and y[3] == x[3]), key=lambda y: (y[8] != "matched", not y[7], y[0]))
            if first[0] != x[0]:
                want[x[0]] = ("duplicate", [first[0]], want[x[0]][2])
    assert {i: (a, [str(v) for v in b], c) for i, (a, b, c) in got.items()} == {i: (a, [str(v) for v in b], c) for i, (a, b, c) in want.items()}
    assert {v[0] for v in got.values()} == {"rejected", "candidateDuplicate", "conflict", "matched", "duplicate", "import"}
    assert consolidation.routed(df.where("false"), there).count() == 0


def test_merges_read_their_rows_once(spark):
    """Tenures are dealt once, nothing is joined back, and a role's class is told only where a tenure has several roles."""
    rows = [(f"r{i:03}", "p", i // 4, 1, 2, ("King", "King", "Duke", "Monarch")[i % 4]) for i in range(200)] + [("x", "p", 900, 1, 2, "King"), ("y", "p", 901, None, 2, "King"), ("z", "p", 901, None, 2, "King")]
    found = consolidation.merges(spark.createDataFrame(rows, "id string, polity string, person int, `from` int, to int, role string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(x.ids for x in found.collect()) == [[f"r{4 * k:03}", f"r{4 * k + 1:03}", f"r{4 * k + 3:03}"] for k in range(50)]
