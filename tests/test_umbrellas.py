"""Pages that serve several identities at a time."""

import random

from tempora.operators import curation

ROW = "polity long, name string, url string, title string, first int, last int"


def test_umbrellas_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        p, f = rng.randrange(80), rng.randrange(400)
        rows.append((p if i % 29 else None, f"N{p}", rng.choice(["u", "v", "w", f"x{i % 60}", None]), rng.choice([f"n{p}", "list", None]), f if i % 31 else None, f + rng.randrange(-2, 6)))
    met = lambda a, b: None not in (a[0], b[0], a[2], a[3], a[4], b[4]) and a[2] == b[2] and a[0] != b[0] and a[4] <= b[5] and a[5] >= b[4]
    want = {(a[0], a[2]) for a in rows if a[3] is not None and a[3].lower() != a[1].lower() and any(met(a, b) for b in rows)}
    got = curation.umbrellas(spark.createDataFrame(rows, ROW)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 10


def test_one_page_for_all_makes_no_pairs(spark):
    rows = spark.range(200_000).selectExpr("id polity", "'n' name", "'u' url", "'t' title", "cast(id % 100 as int) first", "cast(id % 100 + 50 as int) last")
    assert curation.umbrellas(rows).count() == 200_000
