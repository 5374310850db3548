"""Rectangles in force for a time, streamed by blocks of cells and years."""

import random

from tempora.operators import resolve

BOX = "id long, k string, f int, t int, x0 long, y0 long, x1 long, y1 long"


def boxes(rng, n, people):
    for i in range(n):
        x, y, f = rng.randrange(-70, 70), rng.randrange(-50, 50), rng.randrange(-300, 300)
        yield i, f"k{rng.randrange(people)}", f, f + rng.randrange(300), x, y, x + rng.randrange(1, 45), y + rng.randrange(1, 30)


def test_occupied_by_brute_force(spark):
    rng = random.Random(3)
    parts, records = list(boxes(rng, 60, 4)), list(boxes(rng, 50, 4))
    parts += [(100, None, 0, 1, 0, 0, 2, 2), (101, "k1", 5, 5, 200, 0, 203, 1), (102, "k1", 0, 0, 90, 0, None, 1)]
    records += [(0, None, -500, 500, -80, -80, 80, 80), (0, "k0", 5, 5, 201, 0, 202, 1)]
    want = {}
    for i, k, f, t, x0, y0, x1, y1 in parts:
        met = [r for r in records if k and r[1] and x1 and r[1] != k and r[2] <= t and r[3] >= f]
        want[i] = len({(x, y) for r in met for x in range(max(x0, r[4]), min(x1, r[6])) for y in range(max(y0, r[5]), min(y1, r[7]))})
    got = resolve.occupied(spark.createDataFrame(parts, BOX), spark.createDataFrame(records, BOX)).collect()
    assert {r.id: r.taken for r in got} == want and len(got) == len(parts)


def test_a_crowded_place_makes_no_pairs(spark):
    """20,000 parts and as many records in one place and time: 4 x 10^8 pairs of 100 cells each."""
    rows = spark.range(20_000).selectExpr("id", "id k", "0 f", "9 t", "5L x0", "5L y0", "15L x1", "15L y1")
    got = resolve.occupied(rows, rows.selectExpr("k", "f", "t", "x0", "y0", "x0 + 1 + k % 2 x1", "y1"))
    assert got.selectExpr("count(*)", "min(cells)", "min(taken)", "max(taken)").first() == (20_000, 100, 20, 20)


def test_all_records_are_asked_about(spark):
    """Records of all years have their parts, not those around year 0 alone."""
    from tempora.plans import catalog
    from tempora.sources import derived

    d = "/root/testdata/sf0.001"
    n = derived.boxes(spark, d).count()
    assert catalog.QUERIES["j12_occupied"](spark, d).count() == 3 * n


def test_homes_are_of_all_years(spark):
    """Each record has an anchor, at home where a part holds the least corners of all its identity's records."""
    from tempora.plans import catalog
    from tempora.sources import derived

    d = "/root/testdata/sf0.001"
    boxes = derived.boxes(spark, d).collect()
    want = {}
    for b in boxes:
        x, y = min(o.x0 for o in boxes if o.k == b.k) + 1, min(o.y0 for o in boxes if o.k == b.k)
        wide = [(b.x0, b.x0 + 2), (b.x0 + 3, b.x0 + 4 + b.a % 3), (b.x0 + 30, b.x0 + 31 + b.a % 9)]
        want[b.k * 100_000 + b.f] = b.y0 <= y < b.y1 and any(lo <= x < hi for lo, hi in wide)
    got = {r.rec: r.why == "home" for r in catalog.QUERIES["w13_anchors"](spark, d).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_a_later_one_is_met_many_windows_after(spark):
    """Windows of years without rows in between, parts that end there, and cells that others take in turns."""
    parts = [(1, "a", 0, 5000, 0, 0, 4, 1), (2, "a", 0, 900, 0, 0, 4, 1), (3, "b", 4000, 4001, 0, 0, 4, 1), (4, "a", 0, 5000, 0, 5, 4, 6)]
    records = [(0, "b", 3000, 3001, 0, 0, 2, 1), (0, "a", 0, 9000, 0, 0, 3, 1), (0, "c", 4500, 9000, 1, 0, 3, 1), (0, "b", 100, 101, 3, 0, 4, 1)]
    got = resolve.occupied(spark.createDataFrame(parts, BOX), spark.createDataFrame(records, BOX)).collect()
    assert {r.id: r.taken for r in got} == {1: 4, 2: 1, 3: 3, 4: 0}


def test_successors_names_by_brute_force(spark, monkeypatch):
    """Blocks of more rows than are held at a time; equal shares, names that are null or told by several."""
    from tempora.operators import tiles

    monkeypatch.setattr(tiles, "HELD", 7)
    rng = random.Random(5)
    records = [(*b[1:4], *b[4:], rng.choice([None, "a", "b", f"n{i}", f"m{i % 9}"])) for i, b in enumerate(boxes(rng, 400, 60))]
    subjects = [(f"k{i}", rng.randrange(-200, 400), *b[4:]) for i, b in enumerate(boxes(rng, 60, 1))]
    want = set()
    for k, edge, x0, y0, x1, y1 in subjects:
        best = {}
        for k2, f, t, a0, b0, a1, b1, n in records:
            share = max(0, min(x1, a1) - max(x0, a0)) * max(0, min(y1, b1) - max(y0, b0)) / ((x1 - x0) * (y1 - y0))
            if k2 != k and f <= edge <= t and share > 0.03:
                best[n] = max(best.get(n, 0), share)
        order = sorted(best, key=lambda n: (-best[n], n is not None, n or ""))[:4]
        want |= {(k, i + 1, n, best[n]) for i, n in enumerate(order)}
    told = spark.createDataFrame(records, "k string, f int, t int, x0 long, y0 long, x1 long, y1 long, n string")
    got = tiles.nearest_names(spark.createDataFrame(subjects, "k string, edge int, x0 long, y0 long, x1 long, y1 long"), told, 0.03, 4).select("k", "rank", "name", "share").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_successors_shuffle_no_pairs(spark):
    """Joins of subjects with records leave the plan: what is shuffled by k and name are at most top rows of a subject and block."""
    from tempora.operators import spatial

    rows = spark.range(3000).selectExpr("id k", "concat('n', id) n", "cast(id % 2 * 10 as int) f", "cast(id % 2 * 10 + 10 - id % 2 as int) t", "id % 100 a", "0L x0", "0L y0", "4L x1", "4L y1")
    found = spatial.successors(rows)
    assert found.selectExpr("count(*)", "count(distinct k)", "max(pct)").first() == (9000, 1500, 100.0)
    assert "MapInArrow" in found._jdf.queryExecution().toString()


def test_smallest_box_by_brute_force(spark):
    from tempora.operators import spatial

    rng = random.Random(7)
    held = [b[1:] for b in boxes(rng, 150, 40)] + [("k0", 0, 0, 5, 5, 9, 9), ("a", 0, 0, 5, 5, 9, 9), ("z", 0, 0, 3, 3, 3, 9), (None, 0, 0, -3, -3, 1, 1)]
    points = [(i, rng.uniform(-80, 120), rng.uniform(-60, 90)) for i in range(400)] + [(400, 5.0, 5.0), (401, 8.99, 8.99), (402, None, 1.0), (403, -2.5, 0.0)]
    want = {}
    for i, x, y in points:
        on = [((b[5] - b[3]) * (b[6] - b[4]), b[0] is not None, b[0] or "") for b in held if x is not None and b[3] <= x < b[5] and b[4] <= y < b[6]]
        if on:
            n, known, k = min(on)
            want[i] = (k if known else None, n)
    found = spatial.containing(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(held, "k string, f int, t int, x0 long, y0 long, x1 long, y1 long"))
    assert {r.id: (r.k, r["size"]) for r in found.collect()} == want


def test_points_and_boxes_in_one_place_make_no_pairs(spark):
    from tempora.operators import spatial

    many = spark.range(100_000)
    found = spatial.containing(many.selectExpr("id", "1 x", "1 y"), many.selectExpr("id k", "0L x0", "0L y0", "3L x1", "3L y1", "'' n", "'' s"))
    assert found.selectExpr("count(*)", "max(k)", "max(size)").first() == (100_000, 0, 9)


def test_overlapping_pairs_are_found_in_parts_and_not_shuffled(spark, monkeypatch):
    from tempora.operators import tiles

    rng = random.Random(5)
    rows = []
    for i in range(260):
        x, y, f = rng.randint(-70, 60), rng.randint(-50, 40), rng.randint(-90, 60)
        rows.append((i % 90, f, f + rng.randint(0, 80), x, y, x + rng.choice((0, 3, 9, 25, 70)), y + rng.choice((1, 4, 11, 45))))
    rows += [(None, -50, 50, 0, 0, 9, 9), (2, -50, 50, 0, 0, 9, 9), (1 << 60, -50, 50, 0, 0, 9, 9)]
    want = {}
    for a in rows:
        for b in rows:
            w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
            if None in (a[0], b[0]) or not a[0] < b[0] or w <= 0 or h <= 0 or w * h < 0.3 * min((a[5] - a[3]) * (a[6] - a[4]), (b[5] - b[3]) * (b[6] - b[4])):
                continue
            for year in range(-60, 61, 30):
                if max(a[1], b[1]) <= year <= min(a[2], b[2]):
                    want.setdefault((a[0], b[0]), set()).add(year)
    boxes = spark.createDataFrame(rows, "k long, f int, t int, x0 int, y0 int, x1 int, y1 int")
    for compared, held in ((1 << 24, 40_000), (50, 7)):
        monkeypatch.setattr(tiles, "COMPARED", compared)
        monkeypatch.setattr(tiles, "HELD", held)
        found = resolve.overlapping_claims(boxes, -60, 60, 30)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = found.collect()
        assert len(got) == len(want) and {(r.k1, r.k2): r.years for r in got} == {p: len(y) for p, y in want.items()}
    assert resolve.overlapping_claims(boxes.where("false"), -60, 60, 30).count() == 0


def test_rows_that_go_to_many_tasks_are_packed():
    import numpy as np

    from tempora.operators import tiles

    rng = np.random.default_rng(2)
    k, at = np.sort(rng.integers(-(1 << 40), 1 << 40, 5000)), rng.integers(-3, 4, 5000).astype(np.int32)
    low = rng.integers(-180, 160, (2, 5000)).astype(float)
    whole = np.concatenate((low, low + rng.integers(1, 20, (2, 5000))))
    for corners in (whole, whole + 0.1, np.where(whole == whole.max(), np.inf, whole), np.where(whole == whole.max(), 2.0**40, whole)):
        data = tiles._packed(k, at, corners)
        got = [c.to_numpy() for c in tiles._unpacked(data).columns]
        assert (got[0] == k).all() and (got[1] == at).all() and (np.stack(got[2:]) == corners).all()
    assert len(tiles._packed(np.sort(rng.integers(0, 50_000, 5000)), at, whole)) < 5000 * 6 * 8 / 4
