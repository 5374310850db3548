"""Simplification that keeps borders common: rings are cut into arcs where other borders join them, each arc is simplified once, and
arcs that would then meet another one, or pass over a corner of it, are simplified less until none does.

A corner where not just two edges of all rings meet ends an arc; a ring without such corners is an arc of its own, which begins at its
smallest corner. An arc is known by its corners in the one of its two directions that begins smaller, so that neighbours name
it alike. What meets is found in tiles, and what lies between an arc and its simplified self by a join of points and polygons: no
task sees more than its part of the map.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.functions import geometry as G
from tempora.functions import overlay as O
from tempora.functions.geometry import kept_points
from tempora.operators import quadtree
from tempora.sources.stores import dropped, written

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
#: After so many halvings of the tolerance an arc that is still in the way keeps all of its corners.
HALVINGS = 8
TILE = 10.0


def rings_of(df: DataFrame, shape: str) -> DataFrame:
    """id, polygon, ring and its points without the closing one, as the reader numbers them."""
    polygons = df.select("id", F.posexplode(shape).alias("polygon", "__p"))
    return polygons.select("id", "polygon", F.posexplode("__p").alias("ring", "__r")).select("id", "polygon", "ring", F.slice("__r", F.lit(1), F.greatest(F.size("__r") - 1, F.lit(0))).alias("points"))


def joints(rings: DataFrame) -> DataFrame:
    """Corners (x, y) where not just two edges meet."""
    at = lambda k: F.get(F.col("points"), F.pmod(F.col("i") + k, F.size("points")))
    ends = rings.select(F.posexplode("points").alias("i", "p"), "points").select("p.x", "p.y", F.explode(F.array(at(-1), at(1))).alias("to"))
    return ends.groupBy("x", "y").agg(F.count_distinct("to").alias("n")).where("n <> 2").select("x", "y")


def _arcs(x: np.ndarray, y: np.ndarray, joint: np.ndarray) -> list[tuple[bytes, bool, np.ndarray]]:
    """Arcs of a ring in its order: name, whether it runs against its name's direction, and its places in that direction."""
    n = len(x)
    cuts = np.flatnonzero(joint)
    if not len(cuts):
        start = int(np.lexsort((y, x))[0])
        parts = [np.r_[start : start + n + 1] % n]
    else:
        ends = np.append(cuts[1:], cuts[0] + n)
        parts = [np.r_[a : b + 1] % n for a, b in zip(cuts, ends, strict=True)]
    out = []
    for p in parts:
        forth, back = (list(zip(x[q].tolist(), y[q].tolist(), strict=True)) for q in (p, p[::-1]))
        turned = back < forth
        q = p[::-1] if turned else p
        out.append((hashlib.sha256(np.stack([x[q], y[q]]).tobytes()).digest(), turned, q))
    return out


def cut(rings: DataFrame, corners: DataFrame) -> DataFrame:
    """rings with a row for each arc: at (its place in the ring), arc, turned and its points."""
    marked = rings.select("id", "polygon", "ring", "points", F.posexplode("points").alias("i", "p")).select("id", "polygon", "ring", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    found = marked.join(corners, ["x", "y"], "left_semi").groupBy("id", "polygon", "ring").agg(F.collect_set("i").alias("joints"))
    line = rings.join(found, ["id", "polygon", "ring"], "left").select("id", "polygon", "ring", "points", F.coalesce("joints", F.array().cast("array<int>")).alias("joints"))
    kind = dict(rings.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, names, turned, points = [], [], [], [], []
            for row, (ring, cuts) in enumerate(zip(batch.column(3), batch.column(4).to_pylist(), strict=True)):
                xy = ring.values
                x, y = (xy.field(k).to_numpy() for k in (0, 1))
                joint = np.zeros(len(x), dtype=bool)
                joint[cuts] = True
                for k, (name, back, q) in enumerate(_arcs(x, y, joint) if len(x) else []):
                    rows.append(row)
                    at.append(k)
                    names.append(name)
                    turned.append(back)
                    points.append(xy.take(pa.array(q)).to_pylist())
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(at, pa.int32()), pa.array(names, pa.binary()), pa.array(turned, pa.bool_()), pa.array(points, pa.list_(POINT))], ["id", "polygon", "ring", "at", "arc", "turned", "points"])

    return line.mapInArrow(run, f"id {kind}, polygon int, ring int, at int, arc binary, turned boolean, points {G.RING}")


def _simple(points: list, tolerance: float) -> np.ndarray:
    """Places of the corners that stay. A closed arc keeps its start, the corner farthest from it, and one more on each side."""
    x, y = np.array([p["x"] for p in points]), np.array([p["y"] for p in points])
    if tolerance <= 0 or len(x) < 3:
        return np.arange(len(x))
    if points[0] != points[-1]:
        return np.flatnonzero(kept_points(x, y, tolerance))
    far = int(np.argmax(np.hypot(x - x[0], y - y[0])))
    if not 0 < far < len(x) - 1:
        return np.arange(len(x))
    keep = np.concatenate([kept_points(x[: far + 1], y[: far + 1], tolerance), kept_points(x[far:], y[far:], tolerance)[1:]])
    if keep.sum() < 4:
        away = np.abs((x - x[0]) * (y[far] - y[0]) - (y - y[0]) * (x[far] - x[0]))
        keep[int(np.argmax(away))] = True
    return np.flatnonzero(keep) if keep.sum() >= 4 else np.arange(len(x))


def simpler(arcs: DataFrame) -> DataFrame:
    """arcs (arc, tolerance, points) with kept, the corners that stay, and gaps: rings of what stays and the corners between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gaps = [], []
            for tolerance, points in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = _simple(points, tolerance)
                kept.append([points[i] for i in at])
                gaps.append([[[*points[a : b + 1], points[a]]] for a, b in zip(at, at[1:], strict=False) if b - a > 1])
            shape = pa.list_(pa.list_(pa.list_(POINT)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.list_(POINT)), pa.array(gaps, shape)], ["arc", "tolerance", "points", "kept", "gaps"])

    return arcs.mapInArrow(run, f"arc binary, tolerance double, points {G.RING}, kept {G.RING}, gaps {G.SHAPE}")


def meeting(arcs: DataFrame, size: float = TILE) -> DataFrame:
    """Arcs (arc) whose kept edges meet others, of their own or another arc, except where both have a corner, or that are there twice."""
    lines = arcs.select("arc", F.explode(G.edges(F.col("kept"), lambda p, q: F.struct(p.alias("p"), q.alias("q")))).alias("e"))
    tile = lambda f, k: F.floor(f(F.col(f"e.p.{k}"), F.col(f"e.q.{k}")) / size)
    spread = lambda k: F.explode(F.sequence(tile(F.least, k), tile(F.greatest, k)))
    placed = lines.withColumn("tx", spread("x")).withColumn("ty", spread("y")).select("tx", "ty", "arc", F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"), F.col("e.q.x").alias("qx"), F.col("e.q.y").alias("qy"))

    def run(rows: pa.Table) -> pa.Table:
        px, py, qx, qy = (rows.column(k).to_numpy() for k in ("px", "py", "qx", "qy"))
        (px, qx), (py, qy) = O.near(px, qx), O.near(py, qy)
        ends = [O.snapped(v) for v in (px, py, qx, qy)]
        back = (ends[0] > ends[2]) | ((ends[0] == ends[2]) & (ends[1] > ends[3]))
        flip = lambda a, b: np.where(back, ends[b], ends[a])
        n = rows.num_rows
        e = {"g": np.zeros(n, np.int64), "ax": flip(0, 2), "ay": flip(1, 3), "bx": flip(2, 0), "by": flip(3, 1)}
        bad = np.zeros(n, dtype=bool)
        bad[O.meetings(e)[0]] = True
        _, same, count = np.unique(np.stack([e[k] for k in ("ax", "ay", "bx", "by")]), axis=1, return_inverse=True, return_counts=True)
        bad |= count[same.reshape(-1)] > 1
        bad |= (e["ax"] == e["bx"]) & (e["ay"] == e["by"])
        return pa.table({"arc": rows.column("arc").filter(pa.array(bad))})

    return placed.groupBy("tx", "ty").applyInArrow(run, "arc binary").distinct()


def passed_over(arcs: DataFrame) -> DataFrame:
    """Arcs (arc) that leave a corner of another arc on their other side."""
    gaps = arcs.where(F.size("gaps") > 0).select("arc", F.col("gaps").alias("shape"), F.get("points", F.lit(0)).alias("first"), F.element_at("points", -1).alias("last"))
    corners = arcs.select(F.col("arc").alias("of"), F.explode("points").alias("p")).select("of", "p.x", "p.y")
    inside = quadtree.points_in_polygons(corners, gaps, "of")
    at_end = lambda k: (F.col("x") == F.col(f"{k}.x")) & (F.col("y") == F.col(f"{k}.y"))
    return inside.where((F.col("of") != F.col("arc")) & ~at_end("first") & ~at_end("last")).select("arc").distinct()


def simplified(df: DataFrame, tolerance: float, shape: str = "shape") -> DataFrame:
    """Id and shape of shapes (id, shape) with closed rings, without corners nearer than the tolerance to what stays, where no
    border crosses, touches or passes over another that it did not. Neighbours keep their common borders exactly. Borders that
    touch other borders elsewhere than in common corners count as in each other's way and keep their corners. Null and empty shapes
    stay as they are."""
    rings = written(rings_of(df, shape), "rings")
    pieces = written(cut(rings, joints(rings)), "pieces")
    arcs = written(simpler(pieces.groupBy("arc").agg(F.first("points").alias("points")).select("arc", F.lit(tolerance).cast("double").alias("tolerance"), "points")), "arcs")
    for halving in range(1, HALVINGS + 2):
        bad = written(meeting(arcs).unionByName(passed_over(arcs)).distinct().withColumn("bad", F.lit(True)).join(arcs.where("tolerance > 0").select("arc"), "arc", "left_semi"), "bad")
        if bad.isEmpty():
            dropped(bad)
            break
        less = F.when(F.col("bad"), F.lit(0.0) if halving > HALVINGS else F.col("tolerance") / 2).otherwise(F.col("tolerance"))
        after = written(simpler(arcs.join(bad, "arc", "left").select("arc", less.alias("tolerance"), "points")), "arcs")
        dropped(arcs, bad)
        arcs = after
    parts = pieces.select("id", "polygon", "ring", "at", "arc", "turned").join(arcs.select("arc", "kept"), "arc")
    run = F.when(F.col("turned"), F.reverse("kept")).otherwise(F.col("kept"))
    line = parts.groupBy("id", "polygon", "ring").agg(F.array_sort(F.collect_list(F.struct("at", run.alias("run")))).alias("runs"))
    open_ = F.flatten(F.transform("runs", lambda r: F.slice(r["run"], F.lit(1), F.size(r["run"]) - 1)))
    closed = line.select("id", "polygon", "ring", G.let(open_, lambda p: F.concat(p, F.slice(p, 1, 1))).alias("points"))
    whole = closed.groupBy("id", "polygon").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    shapes = whole.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("polygon", "rings"))), lambda p: p["rings"]).alias("new"))
    return df.select("id", shape).join(shapes, "id", "left").select("id", F.coalesce("new", shape).alias(shape))
