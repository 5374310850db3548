"""Rasters as cells (x, y, value), resampled in tiles.

An output cell is the mean of the input cells around its centre by a separable Lanczos window, stretched where the raster gets
smaller. A tile of output cells needs the input cells below it and a halo as wide as the window; each input cell goes to the tiles
whose halo it lies in, so that no task holds more than a tile's input, and tiles are worked out as two products of matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOBES, TILE = 3, 256


def lanczos(t: np.ndarray, lobes: int = LOBES) -> np.ndarray:
    return np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)


def _weights(first: int, outputs: int, lo: int, inputs: int, scale: float) -> np.ndarray:
    """Rows for outputs first, first + 1, ...; columns for inputs lo, lo + 1, ..."""
    centre = (np.arange(first, first + outputs) + 0.5) * scale
    at = np.arange(lo, lo + inputs) + 0.5
    return lanczos((at[None, :] - centre[:, None]) / max(1.0, scale))


def _tiles(c: Column, scale: float, size: int, tile: int) -> Column:
    """Tiles of output cells that an input cell has a part in, of the size output cells there are."""
    reach = LOBES * max(1.0, scale)
    lo = F.ceil((c + 0.5 - reach) / scale - 0.5)
    hi = F.floor((c + 0.5 + reach) / scale - 0.5)
    bound = lambda v: F.floor(F.least(F.greatest(v, F.lit(0)), F.lit(size - 1)) / tile)
    return F.sequence(bound(lo), bound(hi))


def resampled(cells: DataFrame, width: int, height: int, new_width: int, new_height: int, tile: int = TILE) -> DataFrame:
    """The cells (x, y, value) of a raster of another size. Cells that are missing, null or outside don't count; an output cell whose
    window holds none, or whose weights come to nothing, is missing. Of cells that are there twice the mean counts."""
    sx, sy = width / new_width, height / new_height
    inside = cells.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("value").isNotNull())
    once = inside.groupBy("x", "y").agg(F.avg(F.col("value").cast("double")).alias("value"))
    dealt = once.withColumn("tx", F.explode(_tiles(F.col("x"), sx, new_width, tile))).withColumn("ty", F.explode(_tiles(F.col("y"), sy, new_height, tile)))

    def run(rows: pa.Table) -> pa.Table:
        tx, ty = rows.column("tx")[0].as_py(), rows.column("ty")[0].as_py()
        x, y, value = (rows.column(k).to_numpy() for k in ("x", "y", "value"))
        x0, y0 = int(x.min()), int(y.min())
        grid = np.zeros((2, int(y.max()) - y0 + 1, int(x.max()) - x0 + 1))
        grid[0, y - y0, x - x0] = value
        grid[1, y - y0, x - x0] = 1
        n, m = min(tile, new_width - tx * tile), min(tile, new_height - ty * tile)
        across, down = _weights(tx * tile, n, x0, grid.shape[2], sx), _weights(ty * tile, m, y0, grid.shape[1], sy)
        total, weight = down @ grid[0] @ across.T, down @ grid[1] @ across.T
        j, i = np.nonzero(np.abs(weight) > 1e-9)
        return pa.table({"x": pa.array(i + tx * tile), "y": pa.array(j + ty * tile), "value": pa.array(total[j, i] / weight[j, i])})

    return dealt.groupBy("tx", "ty").applyInArrow(run, "x long, y long, value double")
