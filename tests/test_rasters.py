"""Resampling in tiles against a direct sum over all cells."""

import numpy as np
import pytest

from tempora.operators import rasters


@pytest.mark.parametrize(("new", "tile"), [((32, 32), 16), ((100, 40), 50), ((64, 64), 32), ((1, 1), 16)])
def test_resampling(spark, new, tile):
    r = np.random.default_rng(1)
    grid = r.normal(size=(64, 64))
    here = r.random((64, 64)) > 0.05
    cells = [(x, y, float(grid[y, x])) for y in range(64) for x in range(64) if here[y, x]]
    df = spark.createDataFrame([*cells, (0, 0, None), (64, 3, 9.0), (-1, 3, 9.0)], "x long, y long, value double").repartition(3)
    got = {(c.x, c.y): c.value for c in rasters.resampled(df, 64, 64, *new, tile=tile).collect()}
    sx, sy = 64 / new[0], 64 / new[1]
    window = lambda t: float(np.sinc(t) * np.sinc(t / 3)) if abs(t) < 3 else 0.0
    assert set(got) == {(x, y) for x in range(new[0]) for y in range(new[1]) if new != (64, 64) or here[y, x]}  # at the same size nothing fills gaps
    for (x, y), v in list(got.items())[:: max(1, len(got) // 150)]:
        total = weight = 0.0
        for i, j, value in cells:
            w = window((i + 0.5 - (x + 0.5) * sx) / max(1, sx)) * window((j + 0.5 - (y + 0.5) * sy) / max(1, sy))
            total, weight = total + w * value, weight + w
        assert v == pytest.approx(total / weight, abs=1e-9)


def test_same_size_is_the_same_raster(spark):
    cells = [(x, y, float(x * y % 7)) for x in range(9) for y in range(5)]
    df = spark.createDataFrame([*cells, (2, 2, 4.0)], "x long, y long, value double")
    got = {(c.x, c.y): c.value for c in rasters.resampled(df, 9, 5, 9, 5, tile=4).collect()}
    assert all(got[x, y] == pytest.approx(v, abs=1e-9) for x, y, v in cells)
    assert rasters.resampled(df.where("false"), 9, 5, 3, 3).count() == 0
