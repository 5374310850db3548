"""Simplification of maps whose shapes have borders in common."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_polygons import SHAPE, box, ring

from tempora.functions import geometry as G
from tempora.functions import overlay as O
from tempora.operators import simplify


def wavy(r, p, q, n, size):
    """Points from p towards q, without q, that sway to both sides."""
    t = np.arange(n) / n
    away = np.where(t > 0, r.uniform(-size, size, n), 0)
    dx, dy = q[0] - p[0], q[1] - p[1]
    length = np.hypot(dx, dy)
    return list(zip(p[0] + t * dx - away * dy / length, p[1] + t * dy + away * dx / length, strict=True))


def tiles(r, n, size):
    """n x n squares whose common sides sway alike for both, each a ring without the closing point."""
    sides = {}

    def side(p, q):
        if (q, p) in sides:
            back = sides[q, p]
            return [p, *back[1:][::-1]]
        sides[p, q] = wavy(r, p, q, 12, size)
        return sides[p, q]

    out = []
    for i in range(n):
        for j in range(n):
            c = [(float(i), float(j)), (i + 1.0, float(j)), (i + 1.0, j + 1.0), (float(i), j + 1.0)]
            out.append([q for a, b in zip(c, [*c[1:], c[0]], strict=True) for q in side(a, b)])
    return out


def areas(column):
    return O.areas(O.bounded(O.wound(O.noded(O.shape_edges(column))), O.RULES["first"]), len(column))


@pytest.mark.parametrize(("sway", "tolerance"), [(0.02, 0.05), (0.09, 0.3)])
def test_neighbours_keep_their_border(spark, sway, tolerance):
    r = np.random.default_rng(3)
    shapes = [[[ring(*p, p[0])]] for p in tiles(r, 4, sway)]
    shapes += [[[box(10, 10, 12, 12), box(10.5, 10.5, 11, 11)]], None, [], [[ring(*[(20 + np.cos(t), np.sin(t)) for t in np.linspace(0, 2 * np.pi, 60)[:-1]], (21.0, 0.0))]]]
    df = spark.createDataFrame(list(enumerate(shapes)), f"id int, shape {G.SHAPE}").repartition(3)
    out = {x.id: x["shape"] for x in simplify.simplified(df, tolerance).collect()}
    plain = lambda s: s and [[[{"x": p.x, "y": p.y} for p in q] for q in poly] for poly in s]
    out = [plain(out[i]) for i in range(len(shapes))]
    assert out[16] == shapes[16] and out[17] is None and out[18] == []
    assert all(q[0] == q[-1] for s in out if s for p in s for q in p)
    before, after = (sum(len(q) for s in v if s for p in s for q in p) for v in (shapes, out))
    assert after < before / 3
    column = pa.array(out[:16], SHAPE)
    # Nothing overlaps and nothing gapes: areas of all shapes add up to that of their union, which has no hole.
    edges = O.shape_edges(column)
    union = O.bounded(O.wound(O.noded(edges | {"g": np.zeros_like(edges["g"])})), O.RULES["first"])
    assert O.areas(union, 1)[0] == pytest.approx(areas(column).sum(), abs=1e-9)
    assert [len(p) for p in O.shapes(union, 1).to_pylist()[0]] == [1]
    assert np.abs(areas(pa.array(shapes[:16], SHAPE)) - areas(column)).max() < 8 * tolerance
    own = O.repaired(column).to_pylist()
    assert [len(s) for s in own] == [1] * 16  # no ring crosses itself


def test_a_border_passes_over_nothing(spark):
    """The small box lies in a dent that the tolerance would cut off."""
    dent = ring((0, 0), (10, 0), (10, 10), (6, 10), (5, 9), (4, 10), (0, 10), (0, 0))
    df = spark.createDataFrame([(1, [[dent]]), (2, [[box(4.9, 9.5, 5.1, 9.7)]])], f"id int, shape {G.SHAPE}")
    out = {x.id: x["shape"] for x in simplify.simplified(df, 1.5).collect()}
    assert len(out[1][0][0]) > 5 and (5.0, 9.0) in {(p.x, p.y) for p in out[1][0][0]}
    alone = simplify.simplified(df.where("id = 1"), 1.5).first()["shape"]
    assert (5.0, 9.0) not in {(p.x, p.y) for p in alone[0][0]}
    assert simplify.simplified(df.where("false"), 1.0).count() == 0


def test_arcs_have_one_name_in_both_directions():
    x, y = np.array([0.0, 1, 2, 2, 0]), np.array([0.0, 0.2, 0, 2, 2])
    joint = np.array([True, False, True, False, False])
    one = {a[0]: a[1] for a in simplify._arcs(x, y, joint)}
    two = {a[0]: a[1] for a in simplify._arcs(x[::-1], y[::-1], joint[::-1])}
    assert set(one) == set(two) and all(one[k] != two[k] for k in one)
    closed = [simplify._arcs(np.roll(v, k), np.roll(w, k), np.zeros(5, bool))[0][0] for k in range(5) for v, w in ((x, y), (x[::-1], y[::-1]))]
    assert len(set(closed)) == 1


def test_maps_that_reach_far_out(spark):
    """Tiles beyond 400 degrees, where coordinates themselves don't fit the grid, come out like those near 0."""
    r = np.random.default_rng(3)
    near = [[[ring(*p, p[0])]] for p in tiles(r, 3, 1 / 32)]
    near = [[[[{"x": round(p["x"] * 1024) / 1024, "y": round(p["y"] * 1024) / 1024} for p in q] for q in poly] for poly in s] for s in near]
    moved = [[[[{"x": p["x"] + 450, "y": p["y"] + 1120} for p in q] for q in poly] for poly in s] for s in near]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*near, *moved])], f"id int, shape {G.SHAPE}")
    out = {x.id: x["shape"] for x in simplify.simplified(df, 0.05).collect()}
    plain = lambda s, x, y: [[(p.x - x, p.y - y) for p in q] for poly in s for q in poly]
    got = [plain(out[i], 0, 0) for i in range(9)]
    assert [plain(out[i + 9], 450, 1120) for i in range(9)] == got and sum(len(q) for s in got for q in s) < sum(len(q) for s in near for p in s for q in p)


def test_far_points_are_dealt_to_many_leaves(spark):
    from tempora.operators import quadtree

    points = spark.range(4000).selectExpr("id", "cast(id % 2 as double) x", "400 + id / 4D y")
    tree = quadtree.tree(points, leaves=50)
    leaf = quadtree.placed(points, tree, ["id"]).groupBy("leaf", "salt").count()
    assert leaf.selectExpr("max(count)").first()[0] <= 80
    square = points.selectExpr("id k", "x", "y").select("k", F.array(F.array(ring_of(F.col("x") - 0.5, F.col("y") - 0.1))).alias("shape"))
    assert quadtree.points_in_polygons(points, square, "id", leaves=50).where("id = k").count() == 4000


def ring_of(x, y):
    return F.array(*[G.point(x + a, y + b) for a, b in ((0, 0), (1, 0), (1, 0.2), (0, 0.2), (0, 0))])


def test_rings_of_a_batch_are_simplified_together(spark):
    """As each ring alone by kept_points; rings that are null, empty, short, of one place, or left with less than four points."""
    r = np.random.default_rng(3)

    def alone(ring, tolerance):
        x, y = (np.array([p[k] for p in ring]) for k in "xy")
        far = int(np.argmax(np.hypot(x - x[0], y - y[0]))) if len(ring) >= 5 else 0
        if not 0 < far < len(ring) - 1:
            return ring
        keep = np.concatenate([G.kept_points(x[: far + 1], y[: far + 1], tolerance), G.kept_points(x[far:], y[far:], tolerance)[1:]])
        return [ring[i] for i in np.flatnonzero(keep)] if keep.sum() >= 4 else ring

    rings = []
    for n in [0, 1, 4, *r.integers(0, 30, 300).tolist(), 5, 0]:
        points = np.round(r.uniform(-3, 3, (n, 2)), int(r.integers(0, 3)))
        points = points[:1].repeat(n, axis=0) if n % 9 == 8 else points
        rings.append([{"x": float(a), "y": float(b)} for a, b in [*points, *points[:1]]])
    rows = [(i, [rings[i : i + 3], [], rings[i + 3 : i + 4]]) for i in range(0, len(rings), 4)] + [(1001, None), (1002, []), (1003, [[]])]
    df = spark.createDataFrame(rows, f"id int, shape {G.SHAPE}").coalesce(1)
    for tolerance in (0.0, 0.3, 2.0):
        got = {x.id: x["shape"] and [[[p.asDict() for p in ring] for ring in polygon] for polygon in x["shape"]] for x in df.select("id", G.simplified(F.col("shape"), tolerance).alias("shape")).collect()}
        assert got == {i: s and [[alone(ring, tolerance) for ring in polygon] for polygon in s] for i, s in rows}
    every = np.array([(p["x"], p["y"]) for ring in rings for p in ring]).T
    assert G.kept_of_rings(*every, np.array([len(ring) for ring in rings]), 0.3).sum() == sum(len(alone(ring, 0.3)) for ring in rings)
