"""Overlay of polygons on an integer grid: many groups of edges at a time, in numpy.

Coordinates are rounded to multiples of 1 / GRID degrees, so that every test of sides, crossings and areas is exact in 64-bit
integers. Edges are split where they meet (again after the meeting points are rounded, until no edge meets another except at its
ends); each piece then knows how often each layer winds around the areas to its left and right, and stays where an operation holds
on one side only. Pieces are chained to rings that touch themselves and others in points at most, and holes are given to the ring
around them. Edges are found through buckets along x, so that long chains of short edges stay near linear.

An edge table is a dict of equal long arrays: g (group), ax, ay, bx, by, layer (0 or 1) and w (how often, negative if reversed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

GRID = 1 << 22
#: Coordinates must be smaller than this, in degrees, so that no product overflows.
LARGEST = 400.0
#: Pairs of edges that are compared at a time, and edges in a bucket on average.
PAIRS, PER_BUCKET = 1 << 20, 6

Edges = dict[str, np.ndarray]
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]

#: Where an operation holds, by how often both layers wind around.
RULES: dict[str, Rule] = {
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "union": lambda a, b: (a > 0) | (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
    "symmetric": lambda a, b: (a > 0) != (b > 0),
    "first": lambda a, b: a > 0,
    "second": lambda a, b: b > 0,
    "parity": lambda a, b: a % 2 != 0,
}


def snapped(v: np.ndarray) -> np.ndarray:
    if len(v) and not np.abs(v).max() < LARGEST:
        raise ValueError("coordinates must be numbers below 400 degrees")
    return np.rint(v * GRID).astype(np.int64)


def near(*ends: np.ndarray) -> list[np.ndarray]:
    """Coordinates of a tile that lies far out, on the grid and moved by whole degrees to around 0; others stay."""
    every = np.concatenate(ends)
    if not len(every) or np.abs(every).max() < LARGEST or not np.isfinite(every).all():
        return list(ends)
    low, high = every.min(), every.max()
    middle = np.rint((low + high) / 2)
    return [np.rint(v * GRID) / GRID - middle for v in ends]


def take(e: Edges, which: np.ndarray) -> Edges:
    return {k: v[which] for k, v in e.items()}


def joined(*tables: Edges) -> Edges:
    return {k: np.concatenate([t[k] for t in tables]) for k in ("g", "ax", "ay", "bx", "by", "layer", "w")}


def merged(e: Edges) -> Edges:
    """Edges that run upwards (in x, then y), each once for its layer with the sum of its w; those that cancel out go."""
    back = (e["ax"] > e["bx"]) | ((e["ax"] == e["bx"]) & (e["ay"] > e["by"]))
    flip = lambda a, b: np.where(back, e[b], e[a])
    e = {"g": e["g"], "ax": flip("ax", "bx"), "ay": flip("ay", "by"), "bx": flip("bx", "ax"), "by": flip("by", "ay"), "layer": e["layer"], "w": np.where(back, -e["w"], e["w"])}
    e = take(e, (e["ax"] != e["bx"]) | (e["ay"] != e["by"]))
    if not len(e["g"]):
        return e
    keys = ("layer", "by", "bx", "ay", "ax", "g")
    e = take(e, np.lexsort([e[k] for k in keys]))
    first = np.concatenate(([True], np.any([e[k][1:] != e[k][:-1] for k in keys], axis=0)))
    w = np.add.reduceat(e["w"], np.flatnonzero(first))
    e = take(e, first) | {"w": w}
    return take(e, w != 0)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: each index c[i] times, and 0..c[i]-1 beside it."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Buckets:
    """Edges by stretches of x within their groups."""

    def __init__(self, e: Edges):
        g, self.low = np.unique(e["g"], return_inverse=True)
        n = np.bincount(self.low)
        lo, hi = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
        np.minimum.at(lo, self.low, e["ax"])
        np.maximum.at(hi, self.low, e["bx"])
        self.many = np.maximum(1, n // PER_BUCKET)
        self.lo, self.wide, self.base = lo, np.maximum(1, -(-(hi - lo + 1) // self.many)), np.cumsum(self.many) - self.many
        self.first, self.last = self.of(self.low, e["ax"]), self.of(self.low, e["bx"])
        edge, step = spread(self.last - self.first + 1)
        at = self.first[edge] + step
        self.edges = edge[np.argsort(at, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=int(self.many.sum())))))

    def of(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.base[group] + np.clip((x - self.lo[group]) // self.wide[group], 0, self.many[group] - 1)

    def pairs(self, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index into bucket and edge, for all edges of each bucket, some at a time."""
        n = self.starts[bucket + 1] - self.starts[bucket]
        cut = np.searchsorted(np.cumsum(n), np.arange(PAIRS, int(n.sum()) + PAIRS, PAIRS), side="right")
        for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(n)])), strict=True):
            of, step = spread(n[lo:hi])
            yield of + lo, self.edges[self.starts[bucket[lo:hi]][of] + step]


def side(e: Edges, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Over 0 where (x, y) lies to the left of edge i, which above edges that run upwards in x."""
    return (e["bx"][i] - e["ax"][i]) * (y - e["ay"][i]) - (e["by"][i] - e["ay"][i]) * (x - e["ax"][i])


def meetings(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges and points of the grid at which they have to be split."""
    b = Buckets(e)
    own, step = spread(b.last - b.first + 1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, j in b.pairs(b.first[own] + step):
        i, bucket = own[q], (b.first[own] + step)[q]
        # Two edges that share several buckets are compared in the first of them.
        keep = (i < j) & (bucket == np.maximum(b.first[i], b.first[j]))
        keep &= (e["ax"][i] <= e["bx"][j]) & (e["ax"][j] <= e["bx"][i])
        i, j = i[keep], j[keep]
        top, low = (f(e["ay"], e["by"]) for f in (np.maximum, np.minimum))
        keep = (low[i] <= top[j]) & (low[j] <= top[i])
        i, j = i[keep], j[keep]
        p, q_ = side(e, i, e["ax"][j], e["ay"][j]), side(e, i, e["bx"][j], e["by"][j])
        r, s = side(e, j, e["ax"][i], e["ay"][i]), side(e, j, e["bx"][i], e["by"][i])
        # Ends that lie on the other edge, but not at its ends.
        for one, other, end, sign in ((i, j, "a", p), (i, j, "b", q_), (j, i, "a", r), (j, i, "b", s)):
            x, y = e[end + "x"][other], e[end + "y"][other]
            on = (sign == 0) & (x >= e["ax"][one]) & (x <= e["bx"][one]) & (y >= low[one]) & (y <= top[one])
            on &= ~(((x == e["ax"][one]) & (y == e["ay"][one])) | ((x == e["bx"][one]) & (y == e["by"][one])))
            found.append((one[on], x[on], y[on]))
        cross = (np.sign(p) * np.sign(q_) < 0) & (np.sign(r) * np.sign(s) < 0)
        i, j, p, q_ = i[cross], j[cross], p[cross].astype(np.float64), q_[cross].astype(np.float64)
        t = p / (p - q_)
        x = np.rint(e["ax"][j] + t * (e["bx"][j] - e["ax"][j])).astype(np.int64)
        y = np.rint(e["ay"][j] + t * (e["by"][j] - e["ay"][j])).astype(np.int64)
        found += [(i, x, y), (j, x, y)]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def noded(e: Edges) -> Edges:
    """Edges that meet at their ends only. Each round splits edges at rounded points; as points of the grid are finite and edges
    only get shorter it ends, as a rule after two or three rounds."""
    e = merged(e)
    while len(e["g"]):
        i, x, y = meetings(e)
        at_end = ((x == e["ax"][i]) & (y == e["ay"][i])) | ((x == e["bx"][i]) & (y == e["by"][i]))
        i, x, y = i[~at_end], x[~at_end], y[~at_end]
        if not len(i):
            return e
        along = (x - e["ax"][i]) * (e["bx"][i] - e["ax"][i]) + (y - e["ay"][i]) * (e["by"][i] - e["ay"][i])
        order = np.lexsort((along, i))
        i, x, y = i[order], x[order], y[order]
        cut, n = np.unique(i, return_counts=True)
        # Stops of an edge: its start, the points in order, its end.
        at = np.arange(len(i)) + np.repeat(np.arange(len(cut)), n)
        starts = np.cumsum(n + 1) - (n + 1)
        ends = starts + n
        out = take(e, np.repeat(cut, n + 1))
        out["bx"][at], out["by"][at] = x, y
        out["ax"][at + 1], out["ay"][at + 1] = x, y
        out["ax"][starts], out["ay"][starts] = e["ax"][cut], e["ay"][cut]
        out["bx"][ends], out["by"][ends] = e["bx"][cut], e["by"][cut]
        whole = np.ones(len(e["g"]), dtype=bool)
        whole[cut] = False
        e = merged(joined(take(e, whole), out))
    return e


def wound(e: Edges) -> Edges:
    """noded() edges, each once, with how often layer 0 and 1 wind around its left (l0, l1) and right (r0, r1)."""
    if not len(e["g"]):
        return e | {k: np.zeros(0, dtype=np.int64) for k in ("l0", "l1", "r0", "r1")}
    keys = ("by", "bx", "ay", "ax", "g")
    order = np.lexsort([e[k] for k in keys])
    e = take(e, order)
    first = np.concatenate(([True], np.any([e[k][1:] != e[k][:-1] for k in keys], axis=0)))
    at = np.flatnonzero(first)
    own = [np.add.reduceat(np.where(e["layer"] == k, e["w"], 0), at) for k in (0, 1)]
    e = take(e, first)
    b = Buckets(e)
    x, y = e["ax"] + e["bx"], e["ay"] + e["by"]  # twice the middle
    right = np.zeros((2, len(x)), dtype=np.int64)
    for q, j in b.pairs(b.of(b.low, x // 2)):
        keep = (2 * e["ax"][j] <= x[q]) & (x[q] < 2 * e["bx"][j]) & (q != j)
        q, j = q[keep], j[keep]
        below = (e["bx"][j] - e["ax"][j]) * (y[q] - 2 * e["ay"][j]) - (e["by"][j] - e["ay"][j]) * (x[q] - 2 * e["ax"][j]) > 0
        q, j = q[below], j[below]
        for k in (0, 1):
            right[k] += np.bincount(q, weights=own[k][j], minlength=len(x)).astype(np.int64)
    return {k: e[k] for k in ("g", "ax", "ay", "bx", "by")} | {"l0": right[0] + own[0], "l1": right[1] + own[1], "r0": right[0], "r1": right[1]}


def bounded(e: Edges, rule: Rule) -> Edges:
    """The directed border of where a rule holds, which lies to the left of its edges; from wound()."""
    left, right = rule(e["l0"], e["l1"]), rule(e["r0"], e["r1"])
    e = take(e, left != right)
    back = right[left != right]
    flip = lambda a, b: np.where(back, e[b], e[a])
    return {"g": e["g"], "ax": flip("ax", "bx"), "ay": flip("ay", "by"), "bx": flip("bx", "ax"), "by": flip("by", "ay")}


def areas(e: Edges, groups: int) -> np.ndarray:
    """Square degrees by group of a directed border. Sums of products may wrap around on the way, and end right."""
    out = np.zeros(groups, dtype=np.int64)
    np.add.at(out, e["g"], e["ax"] * e["by"] - e["bx"] * e["ay"])
    return out / (2.0 * GRID * GRID)


def _following(e: Edges) -> np.ndarray:
    """For each edge of a border the one that follows: clockwise the first after its own way back."""
    n = len(e["g"])
    keys = np.stack([np.concatenate((e["g"], e["g"])), np.concatenate((e["ax"], e["bx"])), np.concatenate((e["ay"], e["by"]))])
    order = np.lexsort(keys[::-1])
    new = np.concatenate(([True], np.any(keys[:, order[1:]] != keys[:, order[:-1]], axis=0)))
    vertex = np.empty(2 * n, dtype=np.int64)
    vertex[order] = np.cumsum(new) - 1
    # In long doubles: directions between points of the grid that are less than 2^31 apart differ by more than their precision.
    dx, dy = (np.concatenate((d, -d)).astype(np.longdouble) for d in (e["bx"] - e["ax"], e["by"] - e["ay"]))
    angle = np.arctan2(dy, dx)
    order = np.lexsort((angle, vertex))
    place = np.empty(2 * n, dtype=np.int64)
    place[order] = np.arange(2 * n)
    starts = np.searchsorted(vertex[order], np.arange(vertex.max() + 1))
    ends = np.append(starts[1:], 2 * n)
    here = place[n:]
    v = vertex[n:]
    before = np.where(here == starts[v], ends[v] - 1, here - 1)
    out = order[before]
    if not (out < n).all():
        raise ArithmeticError("a border does not close")
    return out


def rings(e: Edges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a directed border: for each vertex ring and place in it, by ring; x and y. Rings are numbered by group."""
    n = len(e["g"])
    if not n:
        return (np.zeros(0, np.int64),) * 4
    follow = _following(e)
    lowest, jump = np.arange(n), follow
    for _ in range(n.bit_length()):
        lowest = np.minimum(lowest, lowest[jump])
        jump = jump[jump]
    # Steps to the lowest edge of a ring, which ends the chain.
    head = lowest == np.arange(n)
    jump = np.where(head, np.arange(n), follow)
    steps = np.where(head, 0, 1)
    for _ in range(n.bit_length()):
        steps = steps + steps[jump]
        jump = jump[jump]
    order = np.lexsort((-steps, lowest, e["g"]))
    ring = np.cumsum(np.concatenate(([True], lowest[order][1:] != lowest[order][:-1]))) - 1
    return ring, e["g"][order], e["ax"][order], e["ay"][order]


def _straight(ring: np.ndarray, g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a vertex of a ring is a corner."""
    n = np.bincount(ring)
    first = np.cumsum(n) - n
    at = np.arange(len(ring))
    before = np.where(at == first[ring], first[ring] + n[ring] - 1, at - 1)
    after = np.where(at == first[ring] + n[ring] - 1, first[ring], at + 1)
    return (x - x[before]) * (y[after] - y) - (y - y[before]) * (x[after] - x) != 0


def shapes(e: Edges, groups: int) -> pa.Array:
    """A shape (polygons of rings, outer first and anticlockwise, closed) for each group; empty where nothing is."""
    ring, g, x, y = rings(e)
    if len(ring):
        corner = _straight(ring, g, x, y)
        ring, g, x, y = ring[corner], g[corner], x[corner], y[corner]
    n = np.bincount(ring)
    first = np.cumsum(n) - n
    after = np.arange(1, len(ring) + 1)
    after[first + n - 1] = first
    twice = np.add.reduceat(x * y[after] - x[after] * y, first) if len(n) else np.zeros(0, np.int64)
    of = g[first]
    outer, holes = np.flatnonzero(twice > 0), np.flatnonzero(twice < 0)
    around = np.full(len(n), -1)
    around[outer] = outer
    if len(holes):
        around[holes] = _around(holes, outer, of, twice, first, n, x, y, after)
    # Polygons by group and outer ring, holes behind their outer ring.
    order = np.lexsort((np.arange(len(n)), around != np.arange(len(n)), around, of))
    points, step = spread(n[order] + 1)
    at = first[order][points] + step % n[order][points]
    ring_ends = np.concatenate(([0], np.cumsum(n[order] + 1)))
    heads = np.flatnonzero(around[order] == order)
    polygon_ends = np.append(heads, len(order))
    per_group = np.bincount(of[order][heads], minlength=groups) if len(heads) else np.zeros(groups, np.int64)
    xy = pa.StructArray.from_arrays([pa.array(x[at] / GRID), pa.array(y[at] / GRID)], ["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), xy)
    lists = pa.ListArray.from_arrays(pa.array(polygon_ends, pa.int32()), lists)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per_group))), pa.int32()), lists)


def _around(holes, outer, of, twice, first, n, x, y, after) -> np.ndarray:
    """For each hole the smallest outer ring of its group that holds the middle of its first edge, in doubled coordinates."""
    mx, my = x[first[holes]] + x[after[first[holes]]], y[first[holes]] + y[after[first[holes]]]
    low, high = (f.reduceat(x, first) for f in (np.minimum, np.maximum))
    lo = np.searchsorted(of[outer], of[holes], side="left")
    hi = np.searchsorted(of[outer], of[holes], side="right")
    best, size = np.full(len(holes), -1), np.full(len(holes), np.iinfo(np.int64).max)
    h, step = spread(hi - lo)
    o = outer[lo[h] + step]
    keep = (2 * low[o] < mx[h]) & (mx[h] < 2 * high[o]) & (twice[o] > -twice[holes[h]])
    h, o = h[keep], o[keep]
    cuts = np.searchsorted(np.cumsum(n[o]), np.arange(PAIRS, int(n[o].sum()) + PAIRS, PAIRS), side="right")
    for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(o)])), strict=True):
        pair, k = spread(n[o[a:b]])
        p = first[o[a:b]][pair] + k
        q, hx, hy = after[p], mx[h[a:b]][pair], my[h[a:b]][pair]
        spans = (2 * x[p] <= hx) != (2 * x[q] <= hx)
        left = (x[q] - x[p]) * (hy - 2 * y[p]) - (y[q] - y[p]) * (hx - 2 * x[p])
        met = spans & (np.where(x[q] > x[p], left, -left) > 0)
        inside = np.bincount(pair[met], minlength=b - a) % 2 == 1
        for i in np.flatnonzero(inside):
            if twice[o[a + i]] < size[h[a + i]]:
                best[h[a + i]], size[h[a + i]] = o[a + i], twice[o[a + i]]
    if (best < 0).any():
        raise ArithmeticError("a hole lies in no ring")
    return best


def ring_edges(column: pa.Array) -> tuple[Edges, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a column of shapes, one group a row, layer 0, with the number of the ring; of each ring its row, polygon and place
    in it. Rings are closed if they are not; null shapes, polygons and rings have no edges."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def opened(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
        parent = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        return parent, lists.flatten()

    row_of, polygons = opened(column)
    polygon_of, ring_list = opened(polygons)
    ring_of, xy = opened(ring_list)
    x, y = (snapped(xy.field(k).to_numpy(zero_copy_only=False).astype(np.float64)) for k in (0, 1))
    n = np.bincount(ring_of, minlength=len(ring_list))
    first = np.cumsum(n) - n
    after = np.arange(1, len(x) + 1)
    held = np.flatnonzero(n)
    after[first[held] + n[held] - 1] = first[held]
    row = row_of[polygon_of] if len(polygon_of) else np.zeros(0, np.int64)
    e = {"g": row[ring_of] if len(ring_of) else np.zeros(0, np.int64), "ax": x, "ay": y, "bx": x[after] if len(x) else x, "by": y[after] if len(x) else y, "layer": np.zeros(len(x), np.int64), "w": np.ones(len(x), np.int64), "ring": ring_of}
    heads = np.searchsorted(polygon_of, np.arange(len(polygons)))
    place = np.arange(len(polygon_of)) - heads[polygon_of] if len(polygon_of) else np.zeros(0, np.int64)
    return e, row, polygon_of, place


def shape_edges(column: pa.Array, layer: int = 0) -> Edges:
    """Edges of a column of shapes whose rings don't cross themselves: outer rings anticlockwise, holes clockwise."""
    e, row, _, place = ring_edges(column)
    twice = np.zeros(len(row), dtype=np.int64)
    np.add.at(twice, e["ring"], e["ax"] * e["by"] - e["bx"] * e["ay"])
    turned = (twice > 0) != (place == 0)
    w = np.where(turned[e["ring"]], -1, 1) if len(row) else e["w"]
    return {k: e[k] for k in ("g", "ax", "ay", "bx", "by")} | {"layer": np.full(len(w), layer), "w": w}


def directed(e: Edges, layer: int = 0) -> Edges:
    """A border as edges of a layer."""
    return {k: e[k] for k in ("g", "ax", "ay", "bx", "by")} | {"layer": np.full(len(e["g"]), layer), "w": np.ones(len(e["g"]), np.int64)}


def overlaid(one: pa.Array, two: pa.Array) -> Edges:
    """wound() edges of two columns of shapes, row by row."""
    return wound(noded(joined(shape_edges(one, 0), shape_edges(two, 1))))


def repaired(column: pa.Array) -> pa.Array:
    """Shapes whose rings cross neither themselves nor each other: a ring holds what its edges wind around an odd number of times,
    a polygon what its outer ring holds and none of its holes, a shape what any of its polygons holds."""
    e, row, polygon, place = ring_edges(column)
    by_ring = {k: e[k] for k in ("ax", "ay", "bx", "by", "layer", "w")} | {"g": e["ring"]}
    border = bounded(wound(noded(by_ring)), RULES["parity"])
    if len(row):
        # Only polygons with several rings, then rows with several polygons, can change further.
        ring = border["g"]
        several = np.bincount(polygon)[polygon] > 1
        by_polygon = directed(border) | {"g": polygon[ring], "layer": (place[ring] > 0).astype(np.int64)}
        border = directed(border) | {"g": polygon[ring]}
        border = _mended(border, by_polygon, several[ring], "difference")
        row_of = np.zeros(int(polygon.max()) + 1, dtype=np.int64)
        row_of[polygon] = row
        several = np.bincount(row_of[np.unique(polygon)], minlength=len(column)) > 1
        by_row = directed(border) | {"g": row_of[border["g"]]}
        border = _mended(by_row, by_row, several[by_row["g"]], "first")
    return shapes(border, len(column))


def _mended(border: Edges, layers: Edges, which: np.ndarray, rule: str) -> Edges:
    """A border with that of where a rule holds of layers in place of some of its groups."""
    whole = take(border, ~which)
    new = bounded(wound(noded(take(layers, which))), RULES[rule])
    return {k: np.concatenate((whole[k], new[k])) for k in ("g", "ax", "ay", "bx", "by")}


def cut_to_tiles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Edges]:
    """Shapes cut along the lines x, y = k * size of the grid: row, column and line of each tile that holds something, and their
    borders with the tile as group. Edges outside a tile are moved to its sides, where they cancel out but for its own border."""
    e = merged(shape_edges(column))
    if not len(e["g"]):
        return (np.zeros(0, np.int64),) * 3 + (directed(e),)
    for a, b in (("x", "y"), ("y", "x")):  # split at lines
        lo, hi = np.minimum(e["a" + a], e["b" + a]), np.maximum(e["a" + a], e["b" + a])
        k0, k1 = lo // size + 1, -(-hi // size) - 1
        of, step = spread(np.maximum(0, k1 - k0 + 1))
        if not len(of):
            continue
        up = e["a" + a] <= e["b" + a]
        line = np.where(up[of], k0[of] + step, k1[of] - step) * size
        t = (line - e["a" + a][of]) / (e["b" + a] - e["a" + a])[of]
        other = np.rint(e["a" + b][of] + t * (e["b" + b] - e["a" + b])[of]).astype(np.int64)
        n = np.bincount(of, minlength=len(lo))
        out = take(e, np.repeat(np.arange(len(lo)), n + 1))
        at = np.arange(len(of)) + of
        out["b" + a][at], out["b" + b][at] = line, other
        out["a" + a][at + 1], out["a" + b][at + 1] = line, other
        e = out
    # Tiles of each row's bounds; what lies in a row of tiles is taken first, so that an edge meets rows and columns, not all tiles.
    parts = []
    for axis, other in (("y", "x"), ("x", "y")):
        g, low = np.unique(e["g"], return_inverse=True)
        lo, hi = np.full(len(g), np.iinfo(np.int64).max), np.full(len(g), np.iinfo(np.int64).min)
        np.minimum.at(lo, low, np.minimum(e["a" + axis], e["b" + axis]))
        np.maximum.at(hi, low, np.maximum(e["a" + axis], e["b" + axis]))
        k0, k1 = lo // size, np.maximum(lo // size, -(-hi // size) - 1)
        of, step = spread((k1 - k0 + 1)[low])
        k = k0[low][of] + step
        out = take(e, of)
        for end in ("a", "b"):
            out[end + axis] = np.clip(out[end + axis], k * size, (k + 1) * size)
        least, many = int(k.min()), int(k.max() - k.min()) + 1
        group, index = np.unique(out["g"] * many + (k - least), return_inverse=True)
        parts.append((group // many, group % many + least))
        e = merged(out | {"g": index})
        if not len(e["g"]):
            return (np.zeros(0, np.int64),) * 3 + (directed(e),)
    strip, column_of = parts[1]
    row, line = parts[0][0][strip], parts[0][1][strip]
    border = bounded(wound(noded(e)), RULES["first"])
    held, index = np.unique(border["g"], return_inverse=True)
    return row[held], column_of[held], line[held], border | {"g": index}
