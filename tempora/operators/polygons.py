"""Overlay, repair, dissolving and clipping of polygons (shapes of functions.geometry), cut to tiles so that no layer meets in one task.

Overlay of two columns works row by row in Arrow batches. What many rows have part in works by tiles: shapes are cut along the
lines of a grid of squares, the pieces of a tile are worked on together, and areas are sums over tiles. A tile that holds too many
pieces is united in rounds of at most MOST pieces a group. Shapes of several tiles are put together level by level, two by two
tiles at a time, and only those polygons go up a level that touch a side of their tile.

Shapes are taken on the grid of functions.overlay (about 2.4e-7 degrees); areas are in square degrees. A null shape holds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from tempora.functions import geometry as G
from tempora.functions import overlay as O
from tempora.sources.stores import dropped, written

#: Pieces that are united at once; rows that a task works on together, and about how many edges.
MOST, ROWS, EDGES = 512, 2048, 200_000
#: Degrees of a tile's side.
TILE = 10.0
#: Levels of two by two tiles until one covers the world, from any tile of at least a thousandth of a degree.
WORLD = 720.0


SHAPE = ArrayType(ArrayType(ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType()))))


def _slices(batches: Iterator[pa.RecordBatch], shapes: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, and fewer where their shapes are large."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            size = sum(part.column(part.schema.get_field_index(s)).nbytes for s in shapes) // 16
            many = max(1, -(-size // EDGES))
            step = -(-part.num_rows // many)
            for i in range(0, part.num_rows, step):
                yield part.slice(i, step)


def _mapped(df: DataFrame, shapes: list[str], added: list[tuple[str, DataType]], of: Callable[[list[pa.Array]], list[pa.Array]]) -> DataFrame:
    """df with columns that of works out from some columns of shapes; columns of the same names go."""
    if {name for name, _ in added} & set(shapes):
        raise ValueError("a new column cannot have the name of a shape that it is worked out from")
    df = df.drop(*[name for name, _ in added])
    schema = StructType(list(df.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, shapes):
            out = of([part.column(part.schema.get_field_index(s)) for s in shapes])
            yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *[name for name, _ in added]])

    return df.mapInArrow(run, schema)


def overlaid(df: DataFrame, one: str, two: str, areas: dict[str, str] | None = None, shapes: dict[str, str] | None = None) -> DataFrame:
    """G1: df with the areas and shapes that are asked for, as names of new columns and rules of overlay.RULES."""
    areas, shapes = areas or {}, shapes or {}

    def of(columns: list[pa.Array]) -> list[pa.Array]:
        edges, n = O.overlaid(*columns), len(columns[0])
        border = {rule: O.bounded(edges, O.RULES[rule]) for rule in {*areas.values(), *shapes.values()}}
        return [*[pa.array(O.areas(border[r], n)) for r in areas.values()], *[O.shapes(border[r], n) for r in shapes.values()]]

    return _mapped(df, [one, two], [*[(a, DoubleType()) for a in areas], *[(s, SHAPE) for s in shapes]], of)


def made_valid(df: DataFrame, shape: str, as_: str) -> DataFrame:
    """P5: rings split where they cross themselves and faces kept by parity, holes taken out, parts that overlap united; null where
    nothing is left."""
    fixed = _mapped(df, [shape], [("__fixed", SHAPE)], lambda columns: [O.repaired(columns[0])])
    return fixed.withColumn(as_, F.when(F.size("__fixed") > 0, F.col("__fixed"))).drop("__fixed")


def planar_areas(df: DataFrame, shape: str, as_: str) -> DataFrame:
    """Areas on the grid, of what any polygon of a shape holds."""
    return _mapped(df, [shape], [(as_, DoubleType())], lambda columns: [pa.array(O.areas(O.bounded(O.wound(O.noded(O.shape_edges(columns[0]))), O.RULES["first"]), len(columns[0])))])


def tiled(df: DataFrame, shape: str = "shape", size: float = TILE) -> DataFrame:
    """df with a row for each tile (tx, ty) that a shape has part in, the shape cut to it; shapes that hold nothing go."""
    steps = round(size * O.GRID)
    kept = df.drop("tx", "ty")
    schema = StructType(list(kept.schema.fields)).add("tx", "long").add("ty", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, [shape]):
            at = part.schema.get_field_index(shape)
            row, x, y, border = O.cut_to_tiles(part.column(at), steps)
            columns = [c.take(pa.array(row)) for c in part.columns]
            columns[at] = O.shapes(border, len(row))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x), pa.array(y)], [*part.schema.names, "tx", "ty"])

    return kept.mapInArrow(run, schema)


def united(df: DataFrame, keys: list[str], shape: str = "shape") -> DataFrame:
    """The union of the shapes of each of keys; df's groups must fit into a task. Groups are worked on side by side."""
    schema = StructType([f for f in df.schema.fields if f.name in keys]).add(shape, SHAPE)
    names = [f.name for f in schema.fields]

    def union(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(k).combine_chunks() for k in names[:-1]]
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for c in columns:  # equal keys stand together
            codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        group = np.cumsum(new) - 1
        edges = O.shape_edges(rows.column(shape).combine_chunks())
        edges["g"] = group[edges["g"]]
        border = O.bounded(O.wound(O.noded(edges)), O.RULES["first"])
        heads = pa.array(np.flatnonzero(new))
        return pa.RecordBatch.from_arrays([*[c.take(heads) for c in columns], O.shapes(border, int(new.sum()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _slices(batches, [shape]):
            rows = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
            last = [rows.column(k)[rows.num_rows - 1] for k in names[:-1]]
            cut = rows.num_rows  # the last group may go on in the next batch
            while cut and all(rows.column(k)[cut - 1] == v for k, v in zip(names[:-1], last, strict=True)):
                cut -= 1
            held = rows.slice(cut)
            if cut:
                yield union(rows.slice(0, cut))
        if held is not None and held.num_rows:
            yield union(held)

    return df.select(*names).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def tile_unions(df: DataFrame, keys: list[str], shape: str = "shape", size: float = TILE) -> DataFrame:
    """A4: for each of keys (not null) and tile (tx, ty) the union of the shapes' pieces, in rounds of MOST pieces where a tile
    holds more."""
    by = [*keys, "tx", "ty"]
    pieces = written(tiled(df.select(*keys, shape), shape, size), "pieces")
    while True:
        counts = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        most = counts.agg(F.max("__n")).first()[0] or 0
        if most <= MOST:
            break
        # Pieces that are there more than once add nothing; the rest is dealt to groups, whose unions go into the next round.
        once = pieces.dropDuplicates([*by, shape])
        counts = once.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        dealt = once.join(counts, by).withColumn("__salt", F.pmod(F.xxhash64(shape), F.ceil(2 * F.col("__n") / MOST)))
        after = written(united(dealt, [*by, "__salt"], shape).drop("__salt"), "pieces")
        dropped(pieces)
        pieces = after
    out = united(pieces, by, shape)
    out.scratch = pieces.scratch
    return out


def union_areas(df: DataFrame, keys: list[str], shape: str = "shape", size: float = TILE) -> DataFrame:
    """A4, A5: the area of the union of all shapes of each of keys, added up over tiles."""
    return planar_areas(tile_unions(df, keys, shape, size), shape, "area").groupBy(*keys).agg(F.sum("area").alias("area"))


def _touches(shape: str, size: float) -> Column:
    """Whether a polygon of a tile touches one of its sides."""
    b = lambda k: F.col(f"__b.{k}")
    return (b("x0") <= F.col("tx") * size) | (b("y0") <= F.col("ty") * size) | (b("x1") >= (F.col("tx") + 1) * size) | (b("y1") >= (F.col("ty") + 1) * size)


def dissolved(df: DataFrame, keys: list[str], shape: str = "shape", size: float = TILE) -> DataFrame:
    """A row for each polygon of the union of the shapes of each of keys, whose polygons touch in points at most."""
    pieces, done = written(tile_unions(df, keys, shape, size), "level"), None
    while True:
        last = size >= WORLD
        parts = pieces.withColumn(shape, F.explode(F.transform(shape, lambda p: F.array(p)))).withColumn("__b", G.bounds(F.col(shape)))
        inside = parts.where(~_touches(shape, size)).select(*keys, shape)
        done = inside if done is None else done.unionByName(inside)
        # Above the last level there is one tile for all that is left.
        above = lambda c: F.lit(0).cast("long") if last else F.floor(F.col(c) / 2)
        up = parts.where(_touches(shape, size)).withColumns({"tx": above("tx"), "ty": above("ty")})
        pieces = written(united(up.select(*keys, "tx", "ty", shape), [*keys, "tx", "ty"], shape), "level")
        if last:
            return done.unionByName(pieces.select(*keys, F.explode(F.transform(shape, lambda p: F.array(p))).alias(shape)))
        size *= 2


def masked(subjects: DataFrame, masks: DataFrame, size: float = TILE) -> DataFrame:
    """Subjects (id, protected, shape and others) and masks (shape): pieces by tile of what no mask covers, columns id, tx, ty,
    shape, and their areas, whole and left. Protected subjects lose nothing."""
    cover = tile_unions(masks.select(F.lit(1).alias("__all"), "shape"), ["__all"], size=size).select("tx", "ty", F.col("shape").alias("__mask"))
    line = tiled(subjects.select("id", "protected", "shape"), size=size).join(cover, ["tx", "ty"], "left")
    line = line.withColumn("__mask", F.when(~F.col("protected"), F.col("__mask")))
    return overlaid(line, "shape", "__mask", {"whole": "first", "left": "difference"}, {"rest": "difference"}).select("id", "tx", "ty", F.col("rest").alias("shape"), "whole", "left")


def remaining(subjects: DataFrame, masks: DataFrame, size: float = TILE) -> DataFrame:
    """Id, the area left of how much; subjects that lose all go."""
    return masked(subjects, masks, size).groupBy("id").agg(F.sum("left").alias("left"), F.sum("whole").alias("whole")).where(F.col("left") > 0)


def agreements(pairs: DataFrame) -> DataFrame:
    """Pairs (one, two: shapes of the same entity in two sources) with iou and pct, the size of one against two; null where
    two holds nothing."""
    sized = overlaid(pairs, "one", "two", {"__i": "intersection", "__u": "union", "__a": "first", "__b": "second"})
    iou = F.round(F.when(F.col("__u") > 0, F.col("__i") / F.col("__u")).otherwise(0.0), 4)
    pct = F.round(F.when(F.col("__b") > 0, 100 * F.col("__a") / F.col("__b")), 1)
    return sized.withColumns({"iou": iou, "pct": pct}).drop("__i", "__u", "__a", "__b", "one", "two")


def shared_areas(one: DataFrame, two: DataFrame, size: float = TILE) -> DataFrame:
    """For shapes (id, shape) of both sides that have area in common: id, other and shared, added up over tiles."""
    a = tiled(one.select("id", "shape"), size=size).withColumnRenamed("shape", "__a")
    b = tiled(two.select(F.col("id").alias("other"), "shape"), size=size).withColumnRenamed("shape", "__b")
    met = overlaid(a.join(b, ["tx", "ty"]), "__a", "__b", {"shared": "intersection"})
    return met.groupBy("id", "other").agg(F.sum("shared").alias("shared")).where(F.col("shared") > 0)


def coverage(shapes: DataFrame, view: tuple[float, float, float, float], size: float = TILE) -> DataFrame:
    """A5: the share of a view (x0, y0, x1, y1) that any shape covers, and the rest, in percent."""
    box = G.rectangle(*[F.lit(v) for v in view])
    cut = overlaid(tiled(shapes.select("shape"), size=size).withColumn("__view", box), "shape", "__view", {"__in": "intersection"}, {"__cut": "intersection"})
    whole = (view[2] - view[0]) * (view[3] - view[1])
    area = union_areas(cut.where(F.col("__in") > 0).select(F.lit(1).alias("__all"), F.col("__cut").alias("shape")), ["__all"], size=size)
    return area.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area")).select(F.round(100 * F.col("area") / whole, 1).alias("covered"), F.round(100 - 100 * F.col("area") / whole, 1).alias("uncovered"))
