"""Polygons as columns: a ring is an array of struct(x, y) that ends where it begins, a polygon an array of rings, outer first,
and a shape an array of polygons. Degrees of longitude and latitude unless a name says otherwise.

All but simplified(), clipped() and without() are built-in functions, so that they stay inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING, POLYGON, SHAPE = f"array<{POINT}>", f"array<array<{POINT}>>", f"array<array<array<{POINT}>>>"
#: WGS84, and the coefficients of the Equal Earth projection.
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563
A1, A2, A3, A4, M = 1.340264, -0.081106, 0.000893, 0.003796, math.sqrt(3) / 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The shape of one rectangle, anticlockwise."""
    return F.array(F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))))


def edges(ring: Column, of: Callable[[Column, Column], Column]) -> Column:
    """of(p, q) for each edge."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), of)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def ring_area(ring: Column) -> Column:
    """Planar, positive if the ring runs anticlockwise."""
    return total(edges(ring, lambda p, q: (p["x"] * q["y"] - q["x"] * p["y"]) / 2))


def _rings(shape: Column, of: Callable[[Column], Column]) -> Column:
    """Outer rings less holes, by the size that of gives."""
    return total(F.transform(shape, lambda polygon: total(F.transform(polygon, lambda ring, i: F.when(i == 0, F.abs(of(ring))).otherwise(-F.abs(of(ring)))))))


def planar_area(shape: Column) -> Column:
    return _rings(shape, ring_area)


def _authalic() -> tuple[float, float, Callable[[Column], Column]]:
    """e, the square of the authalic radius, and the sine of the authalic latitude of a geographic one."""
    e = math.sqrt(WGS84_F * (2 - WGS84_F))
    q = lambda s: (1 - e * e) * (s / (1 - e * e * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    pole = q(1.0)

    def sine(lat: Column) -> Column:
        s = F.sin(F.radians(lat))
        return (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e)) / pole

    return e, WGS84_A**2 * pole / 2, sine


def geodesic_area(shape: Column) -> Column:
    """Square kilometres on WGS84. Edges are straight in an equal-area cylinder, which is exact along parallels and meridians."""
    _, radius2, sine = _authalic()
    strip = lambda ring: total(edges(ring, lambda p, q: F.radians(q["x"] - p["x"]) * (sine(p["y"]) + sine(q["y"])) / 2))
    return F.coalesce(F.nanvl(_rings(shape, strip), F.lit(0.0)), F.lit(0.0)) * radius2


def mapped(shape: Column, of: Callable[[Column], Column]) -> Column:
    """A shape whose rings are of(ring)."""
    return F.transform(shape, lambda polygon: F.transform(polygon, of))


def rounded(shape: Column, places: int = 3) -> Column:
    """P8."""
    return mapped(shape, lambda ring: F.transform(ring, lambda p: point(F.round(p["x"], places), F.round(p["y"], places))))


def repaired(shape: Column) -> Column:
    """P5: rings without points that repeat the one before, closed, of three corners and some area; polygons that lose their
    outer ring go, and a shape that loses all is null."""

    def whole(ring: Column) -> Column:
        fresh = F.filter(ring, lambda p, i: (i == 0) | ~(F.get(ring, i - 1) == p))
        return let(fresh, lambda r: F.when((F.size(r) > 0) & (F.get(r, F.lit(0)) != F.get(r, F.size(r) - 1)), F.concat(r, F.slice(r, 1, 1))).otherwise(r))

    sound = lambda ring: (F.size(ring) >= 4) & (ring_area(ring) != 0)
    fixed = F.transform(shape, lambda polygon: F.transform(polygon, lambda ring: let(ring, whole)))
    kept = F.filter(fixed, lambda polygon: F.coalesce(sound(F.get(polygon, F.lit(0))), F.lit(False)))
    out = F.transform(kept, lambda polygon: F.filter(polygon, sound))
    return F.when(F.size(out) > 0, out)


def oriented(shape: Column, clockwise: bool = True) -> Column:
    """Outer rings clockwise and holes the other way, or the reverse."""

    def turned(ring: Column, i: Column) -> Column:
        anticlockwise = (i == 0) != F.lit(clockwise)
        return F.when((ring_area(ring) > 0) == anticlockwise, ring).otherwise(F.reverse(ring))

    return F.transform(shape, lambda polygon: F.transform(polygon, turned))


def spherical_area(ring: Column) -> Column:
    """Steradians to the right of a ring, from 0 to 4 pi: what a clockwise ring holds. Each edge adds the excess of the
    triangle that it makes with the south pole."""

    def excess(p: Column, q: Column) -> Column:
        half = lambda lat: F.radians(lat) / 2 + math.pi / 4
        d, a, b = F.radians(q["x"] - p["x"]), half(p["y"]), half(q["y"])
        k = F.sin(a) * F.sin(b)
        return F.atan2(k * F.sin(d), F.cos(a) * F.cos(b) + k * F.cos(d))

    area = 2 * total(edges(ring, excess))
    return let(area, lambda s: s + 4 * math.pi * F.when(s < 0, 1).otherwise(0))


def rewound(shape: Column) -> Column:
    """P20: rings that hold more than half of the sphere run the other way."""
    return mapped(shape, lambda ring: F.when(spherical_area(ring) > 2 * math.pi, F.reverse(ring)).otherwise(ring))


def centroid(shape: Column) -> Column:
    """The planar centre of area; null without area."""

    def moments(ring: Column) -> Column:
        cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
        parts = edges(ring, lambda p, q: F.struct((cross(p, q) / 2).alias("a"), ((p["x"] + q["x"]) * cross(p, q) / 6).alias("x"), ((p["y"] + q["y"]) * cross(p, q) / 6).alias("y")))
        return _sum(parts)

    def signed(ring: Column, i: Column) -> Column:
        side = lambda m: F.when((m["a"] > 0) == (i == 0), 1.0).otherwise(-1.0)
        return let(moments(ring), lambda m: F.struct((m["a"] * side(m)).alias("a"), (m["x"] * side(m)).alias("x"), (m["y"] * side(m)).alias("y")))

    whole = _sum(F.flatten(F.transform(shape, lambda polygon: F.transform(polygon, signed))))
    return let(whole, lambda m: F.when(m["a"] != 0, point(m["x"] / m["a"], m["y"] / m["a"])))


def _sum(parts: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(parts, zero, lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y")))


def holds(shape: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside, by the parity of the edges that a ray to the right meets."""

    def met(ring: Column) -> Column:
        crossing = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"])
        return F.size(F.filter(edges(ring, crossing), lambda c: F.coalesce(c, F.lit(False))))

    return F.exists(shape, lambda polygon: F.aggregate(F.transform(polygon, met), F.lit(0), lambda a, n: a + n) % 2 == 1)


def bounds(shape: Column) -> Column:
    """struct(x0, y0, x1, y1) of all outer rings."""
    outer = F.flatten(F.transform(shape, lambda polygon: polygon[0]))
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


@dataclass
class _Rings:
    """Rings in arrays: points, how many each ring has, and of each ring its polygon, row and whether it is an outer one."""

    x: np.ndarray
    y: np.ndarray
    n: np.ndarray
    polygon: np.ndarray
    row: np.ndarray
    outer: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)

    def closed(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, open_: np.ndarray) -> _Rings:
        """Rings of other points; those that are open get their first point once more."""
        ring = np.repeat(np.arange(len(n)), n)
        shift = np.cumsum(open_) - open_
        at, ends, first = np.arange(len(x)) + shift[ring], np.cumsum(n + open_)[open_] - 1, (np.cumsum(n) - n)[open_]
        out = np.empty((2, len(x) + int(open_.sum())))
        for k, v in enumerate((x, y)):
            out[k, at], out[k, ends] = v, v[first]
        return replace(self, x=out[0], y=out[1], n=n + open_)


def _rings_of(column: pa.Array) -> _Rings:
    polygons, inner = _lists(column)
    rings, inner = _lists(inner)
    points, xy = _lists(inner)
    polygon = np.repeat(np.arange(len(rings)), rings)
    x, y = (xy.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y"))
    place = np.arange(len(polygon)) - (np.cumsum(rings) - rings)[polygon]
    return _Rings(x, y, points, polygon, np.repeat(np.arange(len(polygons)), polygons)[polygon], place == 0)


def _half(r: _Rings, axis: str, bound: np.ndarray, above: bool) -> _Rings:
    """The parts of rings on one side of lines along an axis, a line for each row."""
    ring = r.of
    p = np.flatnonzero(ring[1:] == ring[:-1]) if len(ring) else ring
    ring, q = ring[p], p + 1
    along, other = (r.x, r.y) if axis == "x" else (r.y, r.x)
    at = bound[r.row[ring]]
    p_in, q_in = ((along[i] >= at) if above else (along[i] <= at) for i in (p, q))
    cross = p_in != q_in
    n = cross.astype(np.int64) + q_in
    starts = np.cumsum(n) - n
    out = np.empty((2, int(n.sum())))
    c = np.flatnonzero(cross)
    met = other[p[c]] + (other[q[c]] - other[p[c]]) * (at[c] - along[p[c]]) / (along[q[c]] - along[p[c]])
    for k, own in enumerate("xy"):
        out[k, starts[c]] = at[c] if own == axis else met
        out[k, (starts + cross)[q_in]] = (r.x, r.y)[k][q[q_in]]
    per = np.bincount(ring, weights=n, minlength=len(r.n)).astype(np.int64)
    return r.closed(*out, per, per > 0)


def _sound(r: _Rings) -> tuple[_Rings, np.ndarray]:
    """As repaired(): rings without points that repeat the one before, closed, and which of them stay."""
    ring = r.of
    fresh = np.ones(len(ring), dtype=bool)
    fresh[1:] = (ring[1:] != ring[:-1]) | (r.x[1:] != r.x[:-1]) | (r.y[1:] != r.y[:-1])
    x, y, n = r.x[fresh], r.y[fresh], np.bincount(ring[fresh], minlength=len(r.n))
    ends = np.cumsum(n)
    some = np.flatnonzero(n)
    open_ = np.zeros(len(n), dtype=bool)
    open_[some] = (x[(ends - n)[some]] != x[ends[some] - 1]) | (y[(ends - n)[some]] != y[ends[some] - 1])
    r = r.closed(x, y, n, open_)
    ring = r.of
    p = np.flatnonzero(ring[1:] == ring[:-1]) if len(ring) else ring
    area = np.bincount(ring[p], weights=(r.x[p] * r.y[p + 1] - r.x[p + 1] * r.y[p]) / 2, minlength=len(r.n))
    sound = (r.n >= 4) & (area != 0)
    whole = np.zeros(int(r.polygon.max()) + 1 if len(r.polygon) else 0, dtype=bool)
    whole[r.polygon[r.outer & sound]] = True
    return r, sound & whole[r.polygon]


Sides = list[tuple[str, int, bool]]


def _cut(column: pa.Array, bounds: list[pa.Array], cuts: list[Sides]) -> pa.Array:
    """Shapes of what stays of shapes after cuts, those of one cut after those of another. Sides: axis, number of the bound, above it."""
    at = [b.cast(pa.float64()).to_numpy(zero_copy_only=False) for b in bounds]
    whole, found = _rings_of(column), []
    for sides in cuts:
        r = whole
        for axis, bound, above in sides:
            r = _half(r, axis, at[bound], above)
        found.append(_sound(r))
    ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    lists, rows = [], []
    for r, stays in found:
        points = stays[r.of]
        xy = pa.StructArray.from_arrays([pa.array(r.x[points]), pa.array(r.y[points])], ["x", "y"])
        rings = pa.ListArray.from_arrays(ends(r.n[stays]), xy)
        of, per = np.unique(r.polygon[stays], return_counts=True)
        lists.append(pa.ListArray.from_arrays(ends(per), rings))
        rows.append(r.row[stays & r.outer])
    row = np.concatenate(rows)
    polygons = pa.concat_arrays(lists)
    if len(cuts) > 1:
        polygons = polygons.take(pa.array(np.argsort(row, kind="stable")))
    return pa.ListArray.from_arrays(ends(np.bincount(row, minlength=len(column))), polygons)


def _cutter(cuts: list[Sides]) -> Callable[..., Column]:
    def run(shape: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        return _cut(shape, [x0, y0, x1, y1], cuts)

    return F.arrow_udf(run, SHAPE)


def clipped(shape: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part of a shape inside a rectangle. Parts of one ring that fall apart stay joined along its border."""
    return _cutter([[("x", 0, True), ("x", 2, False), ("y", 1, True), ("y", 3, False)]])(shape, x0, y0, x1, y1)


def without(shape: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The part outside a rectangle: left, right, below and above of it."""
    middle: Sides = [("x", 0, True), ("x", 2, False)]
    return _cutter([[("x", 0, False)], [("x", 2, True)], [*middle, ("y", 1, False)], [*middle, ("y", 3, True)]])(shape, x0, y0, x1, y1)


def equal_earth(lon: Column, lat: Column) -> Column:
    """struct(x, y) in radians of the sphere."""
    l = F.asin(M * F.sin(F.radians(lat)))

    def at(l: Column) -> Column:
        l2 = l * l
        l6 = l2 * l2 * l2
        return point(F.radians(lon) * F.cos(l) / (M * (A1 + 3 * A2 * l2 + l6 * (7 * A3 + 9 * A4 * l2))), l * (A1 + A2 * l2 + l6 * (A3 + A4 * l2)))

    return let(l, at)


def from_equal_earth(x: Column, y: Column, rounds: int = 8) -> Column:
    """struct(x, y) of longitude and latitude by Newton's method; null outside the map."""

    def step(l: Column) -> Column:
        l2 = l * l
        l6 = l2 * l2 * l2
        return l - (l * (A1 + A2 * l2 + l6 * (A3 + A4 * l2)) - y) / (A1 + 3 * A2 * l2 + l6 * (7 * A3 + 9 * A4 * l2))

    l = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), y.cast("double"), lambda l, _: step(l))

    def back(l: Column) -> Column:
        l2 = l * l
        l6 = l2 * l2 * l2
        s = F.sin(l) / M
        lon = F.degrees(M * x * (A1 + 3 * A2 * l2 + l6 * (7 * A3 + 9 * A4 * l2)) / F.cos(l))
        return F.when((F.abs(s) <= 1) & (F.abs(lon) <= 180.0000001), point(lon, F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), s))))))

    return let(l, back)


def orthographic(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """struct(x, y) on a globe of radius 1 that is seen from above (lon0, lat0); null on its far side."""
    d, a, b = F.radians(lon - lon0), F.radians(lat), F.radians(lat0)
    facing = F.sin(b) * F.sin(a) + F.cos(b) * F.cos(a) * F.cos(d)
    return F.when(facing > 0, point(F.cos(a) * F.sin(d), F.cos(b) * F.sin(a) - F.sin(b) * F.cos(a) * F.cos(d)))


def from_orthographic(x: Column, y: Column, lon0: Column, lat0: Column) -> Column:
    """struct(x, y) of longitude and latitude under a point of that view; null beside the globe."""
    depth, b = F.sqrt(F.greatest(F.lit(0.0), 1 - x * x - y * y)), F.radians(lat0)
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y * F.cos(b) + depth * F.sin(b))))
    lon = F.degrees(F.atan2(x, depth * F.cos(b) - y * F.sin(b))) + lon0
    return F.when(x * x + y * y < 1, point(lon - 360 * F.floor((lon + 180) / 360), F.degrees(lat)))


def distance(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Radians along a great circle."""
    h = F.pow(F.sin(F.radians(lat1 - lat0) / 2), 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.pow(F.sin(F.radians(lon1 - lon0) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def cap(shape: Column) -> Column:
    """struct(x, y, radius): the middle of the corners' directions and the angle to the farthest of them."""
    outer = F.flatten(F.transform(shape, lambda polygon: polygon[0]))
    part = lambda of: total(F.transform(outer, of))
    lon, lat = lambda p: F.radians(p["x"]), lambda p: F.radians(p["y"])
    x, y, z = part(lambda p: F.cos(lat(p)) * F.cos(lon(p))), part(lambda p: F.cos(lat(p)) * F.sin(lon(p))), part(lambda p: F.sin(lat(p)))
    middle = point(F.degrees(F.atan2(y, x)), F.degrees(F.atan2(z, F.hypot(x, y))))
    return let(middle, lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"), F.array_max(F.transform(outer, lambda p: distance(m["x"], m["y"], p["x"], p["y"]))).alias("radius")))


def cap_in_view(cap_: Column, lon0: Column, lat0: Column) -> Column:
    """Whether any of a cap can be on the near side of a globe seen from above (lon0, lat0)."""
    return distance(cap_["x"], cap_["y"], lon0, lat0) - cap_["radius"] < math.pi / 2


def on_near_side(lon: Column, lat: Column, lon0: Column, lat0: Column) -> Column:
    """F7."""
    return distance(lon, lat, lon0, lat0) < math.pi / 2 - 0.005


def fitted_zoom(width: Column, height: Column, extent_width: Column, extent_height: Column, bottom: Column, globe: bool = False) -> Column:
    """How far to zoom in on an extent, above what a panel at the bottom hides; 1 for an extent without size."""
    free = F.greatest(height * 0.3, height - bottom)
    zoom = F.least(width * 0.76 / F.when(extent_width > 0, extent_width), free * 0.74 / F.when(extent_height > 0, extent_height))
    held = F.greatest(F.lit(1.1), F.least(F.lit(6.0 if globe else 18.0), zoom))
    return F.when((extent_width > 0) & (extent_height > 0), held).otherwise(F.lit(1.0))


def weighted_centre(points: Column, x: Column, y: Column, weight: Column) -> Column:
    """P21, an aggregate: the direction of the weighted mean of points where points is true, weights of at least 1; null where they cancel."""
    w = F.when(points & x.isNotNull() & y.isNotNull(), F.greatest(F.lit(1.0), F.coalesce(weight.cast("double"), F.lit(1.0))))
    lon, lat = F.radians(x), F.radians(y)
    vx, vy, vz = F.sum(w * F.cos(lat) * F.cos(lon)), F.sum(w * F.cos(lat) * F.sin(lon)), F.sum(w * F.sin(lat))
    length = F.sqrt(vx * vx + vy * vy + vz * vz)
    return F.when(length >= 1e-9, point(F.degrees(F.atan2(vy, vx)), F.degrees(F.atan2(vz, F.hypot(vx, vy)))))


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a line that stay: those farther than the tolerance from the chord of the part that they stand in."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    parts = [(0, len(x) - 1)]
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length = dx * dx + dy * dy
        at = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
        far = np.hypot(px - at * dx, py - at * dy)
        i = int(np.argmax(far))
        if far[i] > tolerance:
            keep[a + 1 + i] = True
            parts += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many values each list has, none for null, and the values."""
    return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), lists.flatten()


def _of_ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers first, first + 1 and so on, n of each range (not none), and where each begins."""
    starts = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(first - starts, n), starts


def _first_largest(values: np.ndarray, at: np.ndarray, n: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each range and the first place of it, that of a value that is no number before others."""
    largest = np.maximum.reduceat(values, starts)
    top = (values == np.repeat(largest, n)) | np.isnan(values)
    return largest, np.minimum.reduceat(np.where(top, at, np.iinfo(np.int64).max), starts)


def kept_of_rings(x: np.ndarray, y: np.ndarray, n: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of many rings (n points each) that stay: a ring is two lines between its first point and the farthest one, taken as
    kept_points takes them, all lines of a round at once. Rings of less than five points, and those of which less than four would be
    left, stay as they are."""
    first, keep = np.cumsum(n) - n, np.ones(len(x), dtype=bool)
    large = np.flatnonzero(n >= 5)
    if not len(large):
        return keep
    at, starts = _of_ranges(first[large], n[large])
    head = np.repeat(first[large], n[large])
    far = _first_largest(np.hypot(x[at] - x[head], y[at] - y[head]), at, n[large], starts)[1]
    split = (far > first[large]) & (far < first[large] + n[large] - 1)
    large, far = large[split], far[split]
    lo, hi = first[large], first[large] + n[large] - 1
    if not len(large):
        return keep
    keep[_of_ranges(lo, n[large])[0]] = False
    keep[np.concatenate((lo, far, hi))] = True
    a, b = np.concatenate((lo, far)), np.concatenate((far, hi))
    while True:
        open_ = b - a >= 2
        a, b = a[open_], b[open_]
        if not len(a):
            break
        at, starts = _of_ranges(a + 1, b - a - 1)
        of = np.repeat(np.arange(len(a)), b - a - 1)
        dx, dy = (x[b] - x[a])[of], (y[b] - y[a])[of]
        px, py = x[at] - x[a][of], y[at] - y[a][of]
        length = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / np.where(length != 0, length, 1), 0, 1) * (length != 0)
        away, middle = _first_largest(np.hypot(px - along * dx, py - along * dy), at, b - a - 1, starts)
        cut = away > tolerance
        keep[middle[cut]] = True
        a, b = np.concatenate((a[cut], middle[cut])), np.concatenate((middle[cut], b[cut]))
    kept = np.concatenate(([0], np.cumsum(keep)))
    left = kept[hi + 1] - kept[lo]
    keep[_of_ranges(lo[left < 4], n[large][left < 4])[0]] = True
    return keep


def simplified(shape: Column, tolerance: float) -> Column:
    """Rings without points nearer than the tolerance to what stays; a ring that would lose its area stays as it is."""

    @F.arrow_udf(SHAPE)
    def run(column: pa.Array) -> pa.Array:
        polygons, inner = _lists(column)
        rings, inner = _lists(inner)
        points, xy = _lists(inner)
        x, y = (xy.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y"))
        keep = kept_of_rings(x, y, points, tolerance)
        ring = np.repeat(np.arange(len(points)), points)
        ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        out = pa.StructArray.from_arrays([pa.array(x[keep]), pa.array(y[keep])], ["x", "y"])
        out = pa.ListArray.from_arrays(ends(np.bincount(ring[keep], minlength=len(points))), out)
        return pa.ListArray.from_arrays(ends(polygons), pa.ListArray.from_arrays(ends(rings), out), mask=column.is_null())

    return run(shape)


def inner_point(shape: Column) -> Column:
    """A point inside: the centroid if it is, else the middle of the widest stretch that a line of latitude through the middle
    of the largest polygon crosses."""

    def stretch(polygon: Column) -> Column:
        box = bounds(F.array(polygon))

        def crossings(y: Column) -> Column:
            meet = lambda p, q: F.when((p["y"] > y) != (q["y"] > y), (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]) + p["x"])
            return F.array_sort(F.filter(F.flatten(F.transform(polygon, lambda ring: edges(ring, meet))), lambda x: x.isNotNull()))

        def widest(y: Column) -> Column:
            pairs = lambda xs: F.filter(F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("w"), ((F.get(xs, i + 1) + x) / 2).alias("x"), (i % 2).alias("odd"))), lambda s: (s["odd"] == 0) & s["w"].isNotNull())
            return let(crossings(y), lambda xs: point(F.array_max(pairs(xs))["x"], y))

        return let((box["y0"] + box["y1"]) / 2, widest)

    largest = F.array_max(F.transform(shape, lambda polygon, i: F.struct(planar_area(F.array(polygon)).alias("a"), (-i).alias("i"))))["i"]
    centre = centroid(shape)
    return let(centre, lambda c: F.when(holds(shape, c["x"], c["y"]), c).otherwise(stretch(F.get(shape, -largest))))
