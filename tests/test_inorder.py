"""Rows in order, in streams of many groups; overlaps counted without pairs."""

import random

import pytest

from tempora.operators import curation, evidence, temporal, views


@pytest.fixture(autouse=True)
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def no_group_calls(df):
    return "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_label_claims(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 2, 3, 4, 5, None]), i, x := r.randrange(40), y := r.randrange(40), x + r.randint(1, 9), y + r.randint(1, 9)) for i in range(200)]
    df = views.label_claims(spark.createDataFrame(rows, "view int, ord long, x0 int, y0 int, x1 int, y1 int").repartition(5))
    want = {}
    for row in rows:
        meets = any(o[0] == row[0] and want[o[1]] and o[2] < row[4] and o[4] > row[2] and o[3] < row[5] and o[5] > row[3] for o in rows[: row[1]])
        want[row[1]] = not meets
    assert {x.ord: x.placed for x in df.collect()} == want and 0 < sum(want.values()) < 200
    assert no_group_calls(df)


def test_lanes(spark):
    r = random.Random(2)
    rows = [(r.randrange(9), i, f := r.randrange(100), f + r.randint(1, 40)) for i in range(150)]
    df = evidence.lanes(spark.createDataFrame(rows, "key long, id long, f int, t int").repartition(5), 3)
    ends, want = {}, {}
    for key, i, f, t in sorted(rows, key=lambda x: (x[0], x[2], x[3], x[1])):
        own = ends.setdefault(key, [])
        free = [n for n, e in enumerate(own) if e <= f]
        want[i] = free[0] if free else len(own) if len(own) < 3 else None
        if want[i] is not None:
            own[want[i] :] = [t, *own[want[i] + 1 :]]
    assert {x.id: x.lane for x in df.collect()} == want and None in want.values()
    assert no_group_calls(df)


def test_distinct_days(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(6), i, f := r.choice([None, *range(60)] if i % 5 else [None]), None if f is None else f + r.randint(1, 4)) for i in range(160)]
    df = curation.distinct_days(spark.createDataFrame(rows, "p string, q int, ord int, from_day int, to_day int").repartition(5), ["p", "q"])
    want, stand = set(), {}
    for p, q, i, f, t in rows:
        own = stand.setdefault((p, q), [])
        if not own or (own[0][0] is not None and f is not None and all(b <= f or t <= a for a, b in own)):
            own.append((f, t))
            want.add(i)
    got = [x.ord for x in df.collect()]
    assert set(got) == want and len(got) == len(want) > 25 and no_group_calls(df)


def test_overlap_counts(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["x", "y", None]), f := r.randrange(80), f + r.randrange(12)) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, nation string, f int, t int")
    got = temporal.overlap_counts(df.where("k < 60"), df.where("k >= 60"), ["nation"])
    want = {(a[0], n) for a in rows[:60] if a[1] and (n := sum(a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] for b in rows[60:]))}
    assert {(x.k, x.overlaps) for x in got.collect()} == want and want


def test_overlaps_of_all_make_no_pairs(spark):
    rows = spark.range(300_000).selectExpr("id k", "1 nation", "cast(id % 10 as int) f", "cast(id % 10 + 10 as int) t")
    assert {r.overlaps for r in temporal.overlap_counts(rows, rows, ["nation"]).select("overlaps").distinct().collect()} == {300_000}
