"""Polygon overlay, repair, tiles and dissolving against plain evaluations."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tempora.functions import geometry as G
from tempora.functions import overlay as O
from tempora.operators import polygons

SHAPE = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))


def star(r, n, cx, cy, size):
    turn = (np.arange(n) + 0.9 * r.random(n)) * 2 * np.pi / n  # gaps below a half turn: rings don't cross themselves
    far = size * (0.3 + 0.7 * r.random(n))
    return ring(*zip(cx + far * np.cos(turn), cy + far * np.sin(turn), strict=True))


def inside(shape, x, y):
    """By the parity of crossings of each polygon."""

    def odd(polygon):
        n = 0
        for points in polygon:
            for i, p in enumerate(points):
                q = points[(i + 1) % len(points)]
                if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                    n += 1
        return n % 2 == 1

    return any(odd(p) for p in shape)


def areas(column):
    return O.areas(O.bounded(O.wound(O.noded(O.shape_edges(column))), O.RULES["first"]), len(column))


def ring_areas(shape):
    twice = lambda points: sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(points, points[1:], strict=False))
    return sum(twice(r) for p in shape for r in p) / 2


def test_areas_of_stars_add_up():
    r, n = np.random.default_rng(1), 1000
    for _ in range(10):
        one = pa.array([[[star(r, int(r.integers(5, 30)), 0, 0, 10)]] for _ in range(n)], SHAPE)
        two = pa.array([[[star(r, int(r.integers(5, 30)), *r.uniform(-8, 8, 2), 8)], [star(r, 7, *r.uniform(-8, 8, 2), 4)]] for _ in range(n)], SHAPE)
        edges = O.overlaid(one, two)
        border = {k: O.bounded(edges, f) for k, f in O.RULES.items()}
        a = {k: O.areas(b, n) for k, b in border.items()}
        for x, y in (("first", a["intersection"] + a["difference"]), ("union", a["first"] + a["second"] - a["intersection"]), ("symmetric", a["union"] - a["intersection"])):
            assert np.abs(a[x] - y).max() < 1e-9
    for k in ("intersection", "union", "difference", "symmetric"):
        assert np.abs(np.array([ring_areas(s) for s in O.shapes(border[k], n).to_pylist()]) - a[k]).max() < 1e-8


def test_points_lie_where_the_operation_says():
    r, n = np.random.default_rng(2), 60
    hole = lambda x: [star(r, 12, 0, 0, 10), star(r, 6, x, 0, 2)]
    one = [[hole(x)] for x in r.uniform(-0.5, 0.5, n)]
    two = [[[star(r, 15, *r.uniform(-6, 6, 2), 8)], [star(r, 5, *r.uniform(-6, 6, 2), 5)]] for _ in range(n)]
    # Holes may stick out of their stars: repaired first.
    one = O.repaired(pa.array(one, SHAPE))
    edges = O.overlaid(one, pa.array(two, SHAPE))
    logic = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "symmetric": lambda a, b: a != b}
    for k, f in logic.items():
        for s, a, b in zip(O.shapes(O.bounded(edges, O.RULES[k]), n).to_pylist(), one.to_pylist(), two, strict=True):
            for x, y in r.uniform(-14, 14, (40, 2)):
                assert inside(s, x, y) == f(inside(a, x, y), inside(b, x, y))


def test_shared_borders_and_identical_shapes():
    a, b = [[box(0, 0, 2, 2)]], [[box(2, 0, 4, 2)]]
    frame = [[box(0, 0, 6, 6), box(2, 2, 4, 4)]]
    cases = [(a, b), (a, a), (a, None), (None, a), ([], a), (frame, [[box(2, 2, 4, 4)]]), (frame, [[box(1, 1, 5, 5)]]), (a, [[box(1, 0, 3, 1)]])]
    edges = O.overlaid(pa.array([c[0] for c in cases], SHAPE), pa.array([c[1] for c in cases], SHAPE))
    got = {k: O.areas(O.bounded(edges, O.RULES[k]), len(cases)).tolist() for k in ("intersection", "union", "difference")}
    assert got == {"intersection": [0, 4, 0, 0, 0, 0, 12, 1], "union": [8, 4, 4, 4, 4, 36, 36, 5], "difference": [4, 0, 4, 0, 0, 32, 20, 3]}
    union = O.shapes(O.bounded(edges, O.RULES["union"]), len(cases)).to_pylist()
    assert [[len(r) for r in p] for p in union[0]] == [[5]] and [[len(r) for r in p] for p in union[5]] == [[5]]
    rest = O.shapes(O.bounded(edges, O.RULES["difference"]), len(cases)).to_pylist()
    assert [len(s) for s in rest] == [1, 0, 1, 0, 0, 1, 1, 1] and len(rest[6][0]) == 2


def test_rings_in_rings():
    nest = [[box(0, 0, 10, 10), box(1, 1, 9, 9)], [box(2, 2, 8, 8), box(3, 3, 7, 7)], [box(4, 4, 6, 6)]]
    out = O.repaired(pa.array([nest], SHAPE)).to_pylist()[0]
    assert sorted((len(p), ring_areas([p])) for p in out) == [(1, 4.0), (2, 20.0), (2, 36.0)]


@pytest.mark.parametrize(
    ("polygons_", "sizes", "area"),
    [
        ([[ring((0, 0), (2, 2), (2, 0), (0, 2))]], [[4], [4]], 2),  # bow tie, not closed
        ([[ring((0, 0), (2, 0), (2, 1), (5, 1), (2, 1), (2, 2), (0, 2))]], [[5]], 4),  # spike
        ([[box(0, 0, 4, 4), box(1, 1, 2, 3), box(1.5, 2, 3, 2.5)]], [[5, 9]], 13.5),  # holes that overlap
        ([[box(0, 0, 4, 4), box(3, 1, 6, 2)]], [[9]], 15),  # a hole that sticks out
        ([[box(0, 0, 4, 4)], [box(1, 1, 2, 2)]], [[5]], 16),  # a part in a part
        ([[box(0, 0, 2, 2)], [box(1, 1, 3, 3)]], [[9]], 7),  # parts that overlap
        ([[ring((0, 0), (1, 1))], []], [], 0),
        ([[ring(*[(math.cos(0.8 * math.pi * k), math.sin(0.8 * math.pi * k)) for k in range(5)])]], [[4]] * 5, 0.775676),  # five points, the middle is even
        ([[ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0), (2, 0), (2, 2), (0, 2))]], [], 0),  # twice around is even
    ],
)
def test_made_valid(polygons_, sizes, area):
    out = O.repaired(pa.array([polygons_, None], SHAPE)).to_pylist()
    assert out[1] == []
    assert [[len(r) for r in p] for p in out[0]] == sizes
    assert ring_areas(out[0]) == pytest.approx(area, abs=1e-5)


def test_made_valid_of_random_rings():
    r = random.Random(4)
    rings_ = [[[ring(*[(r.randint(0, 8), r.randint(0, 8)) for _ in range(r.randint(3, 12))])]] for _ in range(300)]
    out = O.repaired(pa.array(rings_, SHAPE)).to_pylist()
    for a, b in zip(rings_, out, strict=True):
        for _ in range(20):
            x, y = r.uniform(0, 8), r.uniform(0, 8)
            assert inside(a, x, y) == inside(b, x, y)
    sizes = lambda shape: sorted((len(p), round(ring_areas([p]), 6)) for p in shape)
    assert [sizes(s) for s in O.repaired(pa.array(out, SHAPE)).to_pylist()] == [sizes(s) for s in out]  # valid shapes stay


def test_large_coordinates_are_refused():
    with pytest.raises(ValueError, match="400"):
        O.shape_edges(pa.array([[[box(0, 0, 500, 1)]]], SHAPE))


def stars(n, seed=3):
    r = np.random.default_rng(seed)
    return [[[star(r, int(r.integers(4, 14)), *r.uniform(-20, 20, 2), 9)]] for _ in range(n)]


def frame(spark, shapes, **more):
    rows = [(i, *[v[i] for v in more.values()], s) for i, s in enumerate(shapes)]
    kinds = {"tier": "int", "protected": "boolean"}
    return spark.createDataFrame(rows, ", ".join(["id long", *[f"{k} {kinds[k]}" for k in more], f"shape {G.SHAPE}"])).repartition(3)


def test_tiles(spark):
    shapes = [*stars(40), None, [], [[box(-5, -5, 5, 5), box(-5, -1, 5, 1)]]]
    df = polygons.tiled(frame(spark, shapes), size=5.0)
    rows = df.withColumn("b", G.bounds(df.shape)).collect()
    assert all(r.tx * 5 <= r.b.x0 and r.b.x1 <= (r.tx + 1) * 5 and r.ty * 5 <= r.b.y0 and r.b.y1 <= (r.ty + 1) * 5 for r in rows)
    assert len({(r.id, r.tx, r.ty) for r in rows}) == len(rows)
    sums = {r.id: r.a for r in polygons.planar_areas(df, "shape", "a").groupBy("id").agg({"a": "sum"}).withColumnRenamed("sum(a)", "a").collect()}
    whole = areas(pa.array(shapes, SHAPE))
    assert set(sums) == {i for i, a in enumerate(whole) if a > 0} and all(abs(sums[i] - whole[i]) < 1e-4 for i in sums)


@pytest.mark.parametrize("most", [512, 4])
def test_dissolve(spark, monkeypatch, most):
    monkeypatch.setattr(polygons, "MOST", most)
    monkeypatch.setattr(polygons, "ROWS", 7)
    shapes = stars(60) * 2  # every shape twice
    tier = [i % 60 % 3 for i in range(120)]
    edges = O.shape_edges(pa.array(shapes, SHAPE))
    want_edges = edges | {"g": np.array(tier)[edges["g"]]}
    border = O.bounded(O.wound(O.noded(want_edges)), O.RULES["first"])
    want = O.areas(border, 3)
    parts = [len(s) for s in O.shapes(border, 3).to_pylist()]
    df = frame(spark, shapes, tier=tier)
    got = {r.tier: r.area for r in polygons.union_areas(df, ["tier"], size=5.0).collect()}
    assert all(abs(got[t] - want[t]) < 1e-4 for t in range(3))
    rows = polygons.dissolved(df, ["tier"], size=5.0).collect()
    assert [sum(r.tier == t for r in rows) for t in range(3)] == parts
    assert all(len(r["shape"]) == 1 for r in rows)
    assert all(abs(sum(ring_areas([[[{"x": p.x, "y": p.y} for p in q] for q in r["shape"][0]]]) for r in rows if r.tier == t) - want[t]) < 1e-4 for t in range(3))
    assert polygons.dissolved(df.where("false"), ["tier"]).count() == 0


def test_checkerboard_against_inclusion_and_exclusion(spark):
    tiles = [[[box(x, y, x + 1, y + 1)]] for x in range(-4, 4) for y in range(-4, 4) if (x + y) % 2]
    rows = polygons.dissolved(frame(spark, tiles, tier=[1] * len(tiles)), ["tier"], size=2.0).collect()
    assert len(rows) == 32  # squares that touch in corners stay apart
    tiles += [[[box(-1, -1, 1, 1)]]]
    rows = polygons.dissolved(frame(spark, tiles, tier=[1] * len(tiles)), ["tier"], size=2.0).collect()
    assert sum(len(r["shape"]) for r in rows) == len(rows) and polygons.union_areas(frame(spark, tiles, tier=[1] * len(tiles)), ["tier"]).first().area == 32 + 4 - 2


def test_masks_shares_agreement_and_coverage(spark):
    one, two = stars(25, 5), stars(12, 6)
    protected = [i % 6 == 0 for i in range(25)]
    cover = O.bounded(O.wound(O.noded(O.shape_edges(pa.array(two, SHAPE)) | {"g": np.zeros(sum(len(s[0][0]) for s in two), np.int64)})), O.RULES["first"])
    mask = O.shapes(cover, 1).to_pylist() * 25
    edges = O.overlaid(pa.array(one, SHAPE), pa.array(mask, SHAPE))
    left, whole = (O.areas(O.bounded(edges, O.RULES[k]), 25) for k in ("difference", "first"))
    got = {r.id: r for r in polygons.remaining(frame(spark, one, protected=protected), frame(spark, two), size=5.0).collect()}
    want = {i: whole[i] if protected[i] else left[i] for i in range(25)}
    assert set(got) == {i for i, a in want.items() if a > 1e-6} and all(abs(got[i].left - want[i]) < 1e-4 and abs(got[i].whole - whole[i]) < 1e-4 for i in got)

    met = {(r.id, r.other): r.shared for r in polygons.shared_areas(frame(spark, one), frame(spark, two), size=5.0).collect()}
    pairs = [(i, j) for i in range(25) for j in range(12)]
    edges = O.overlaid(pa.array([one[i] for i, _ in pairs], SHAPE), pa.array([two[j] for _, j in pairs], SHAPE))
    a = {k: O.areas(O.bounded(edges, O.RULES[k]), len(pairs)) for k in ("intersection", "union", "first", "second")}
    assert all(abs(met.get(p, 0) - s) < 1e-4 for p, s in zip(pairs, a["intersection"], strict=True))

    both = spark.createDataFrame([(i, one[i], two[j]) for i, j in pairs[:50]] + [(99, None, one[0]), (98, one[0], None)], f"id long, one {G.SHAPE}, two {G.SHAPE}")
    rows = polygons.agreements(both).collect()
    for r, i, u, x, y in zip(rows, *[v[:50] for v in a.values()], strict=False):
        assert abs(r.iou - i / u) < 1e-4 and abs(r.pct - 100 * x / y) < 0.1
    assert [(r.id, r.iou, r.pct) for r in rows[50:]] == [(99, 0.0, 0.0), (98, 0.0, None)]

    view = pa.array([[[box(-10, -10, 10, 10)]]], SHAPE)
    held = O.areas(O.bounded(O.overlaid(O.shapes(cover, 1), view), O.RULES["intersection"]), 1)[0]
    assert polygons.coverage(frame(spark, two), (-10.0, -10.0, 10.0, 10.0), size=5.0).first().covered == round(held / 4, 1)
    assert tuple(polygons.coverage(frame(spark, two).where("false"), (0.0, 0.0, 1.0, 1.0)).first()) == (0.0, 100.0)


def test_repair_leaves_out_steps_that_cannot_change_a_row():
    """A bow tie beside a square with a hole, and two squares that overlap: alone and together in a column they end the same."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    rect = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    rows = [[[ring((0, 0), (2, 2), (2, 0), (0, 2))]], [[rect(0, 0, 4, 4), rect(1, 1, 2, 5)]], [[rect(0, 0, 2, 2)], [rect(1, 1, 3, 3)]], None, [], [[rect(0, 0, 2, 2), rect(0, 0, 2, 2)], [rect(5, 5, 6, 6)]]]
    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
    whole = O.repaired(pa.array(rows, kind)).to_pylist()
    assert whole == [O.repaired(pa.array([r], kind)).to_pylist()[0] for r in rows]
    column = pa.array(whole, kind)
    assert O.areas(O.bounded(O.wound(O.noded(O.shape_edges(column))), O.RULES["first"]), len(rows)).tolist() == [2, 13, 7, 0, 0, 1]
    assert [len(s) for s in whole] == [2, 1, 1, 0, 0, 1]


def test_rows_that_cost_time_are_dealt_to_all_cores(spark):
    from tempora.plans import catalog  # isort: skip
    from tempora.plans import maps
    from tempora.plans import polygons as plans

    for made in (maps.ells, plans.frames, catalog.QUERIES["p5_made_valid"]):
        assert made(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rings_of_a_batch_are_cut_together(spark):
    """Clipped and what is left, against each other and unit cells, for rectangles with a hole, two of them, none and null; no expression
    is evaluated ring by ring."""
    from pyspark.sql import functions as F

    rect = lambda x0, y0, x1, y1: ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))
    r = random.Random(2)
    rows = []
    for i in range(300):
        x, y = r.randrange(-5, 5), r.randrange(-5, 5)
        a, b = r.randrange(-6, 6), r.randrange(-6, 6)
        rows.append((i, [[rect(x, y, x + 4, y + 4), rect(x + 1, y + 1, x + 2, y + 3)], [rect(x + 6, y, x + 7, y + 1)]], a, b, a + r.randrange(1, 9), b + r.randrange(1, 9)))
    rows += [(1000, None, 0, 0, 1, 1), (1001, [], 0, 0, 1, 1), (1002, [[]], 0, 0, 1, 1), (1003, [[rect(0, 0, 1, 1)]], None, 0, 1, 1)]
    df = spark.createDataFrame(rows, f"id int, shape {G.SHAPE}, x0 int, y0 int, x1 int, y1 int").coalesce(1)
    window = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    cut = df.select("id", G.clipped(F.col("shape"), *window).alias("a"), G.without(F.col("shape"), *window).alias("b"))
    assert "transform(" not in cut._jdf.queryExecution().optimizedPlan().toString()
    got = {o.id: (o.a, o.b) for o in cut.select("id", G.planar_area(F.col("a")).alias("a"), G.planar_area(F.col("b")).alias("b")).collect()}
    for i, shape, x0, y0, x1, y1 in rows[:300]:
        x, y = int(shape[0][0][0]["x"]), int(shape[0][0][0]["y"])
        cells = {(x + a, y + b) for a in range(4) for b in range(4) if not (a == 1 and b in (1, 2))} | {(x + 6, y)}
        inside = sum(x0 <= a < x1 and y0 <= b < y1 for a, b in cells)
        assert got[i] == pytest.approx((inside, 15 - inside), abs=1e-9)
    assert [got[i] for i in (1000, 1001, 1002)] == [(0, 0)] * 3 and got[1003][0] == 0
