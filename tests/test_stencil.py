from __future__ import annotations

import math

import numpy as np
import pytest

from tellurian.operators import blend, grid, stencil
from tests.conftest import array_of, grid_of


def test_plane_and_flat(spark):
    plane = grid_of(spark, [[c for c in range(6)] for _ in range(5)])
    assert array_of(stencil.slope(plane, 1.0), "slope")[2, 2] == pytest.approx(45.0)
    assert array_of(stencil.slope(plane, 1.0, "percent", "central"), "slope")[2, 2] == pytest.approx(100.0)
    flat = grid_of(spark, [[100] * 5] * 5)
    assert np.all(array_of(stencil.slope(flat, 1.0), "slope") == 0)
    assert array_of(stencil.hillshade(flat, 1.0), "hillshade")[0, 0] == pytest.approx(255 * math.cos(math.radians(45)))
    assert np.allclose(array_of(stencil.local_relief(flat, 2), "slrm"), 0)


def test_sun_lights_rising_slopes(spark):
    g = stencil.gradients(grid_of(spark, [[c for c in range(5)] for _ in range(5)]), 1.0)
    lit = array_of(g.select("r", "c", stencil.shade_of(90, 45).alias("v")), "v")
    assert lit[2, 2] == pytest.approx(1.0)


def test_ruggedness(spark):
    peak = grid_of(spark, [[0, 0, 0], [0, 2, 0], [0, 0, 0]])
    assert array_of(stencil.ruggedness(peak), "tri")[1, 1] == pytest.approx(math.sqrt(8 * 4))
    corner = array_of(stencil.ruggedness(grid_of(spark, [[None, 1, 1], [1, 1, 1], [1, 1, 1]])), "tri")
    assert math.isnan(corner[0, 0]) and corner[0, 1] == 0


def test_window_sums_match_slices(spark):
    z = np.random.default_rng(4).uniform(0, 10, (12, 9))
    d = stencil.filled(grid_of(spark, z.tolist()))
    got = array_of(stencil.deviation(d, 3, "dev"), "dev")
    for r, c in ((0, 0), (5, 4), (11, 8)):
        w = z[max(0, r - 3) : r + 4, max(0, c - 3) : c + 4]
        assert got[r, c] == pytest.approx((z[r, c] - w.mean()) / w.std())


def test_mirrored_box_longer_than_the_grid(spark):
    z = np.random.default_rng(5).uniform(0, 10, (4, 3))
    cells = grid_of(spark, z.tolist())
    got = array_of(stencil.box_mean(stencil.filled(cells), "f", 5, grid.grid_stats(cells)), "m")
    wide = np.pad(z, 5, mode="symmetric")
    assert got[1, 2] == pytest.approx(wide[1:12, 2:13].mean())


def test_nodata_round_trip(spark):
    cells = grid_of(spark, [[1, None], [None, 4]])
    tagged = grid.to_nodata(cells)
    assert tagged.where("z = -9999").count() == 2
    assert grid.from_nodata(tagged).where("z IS NULL").count() == 2


def test_empty_grid(spark):
    empty = grid_of(spark, [])
    assert stencil.slope(empty, 1.0).count() == 0
    assert stencil.mstp(empty).count() == 0
    assert blend.report_statistics(empty).first()["valid"] == 0


def test_bad_parameters(spark):
    cells = grid_of(spark, [[1.0]])
    for call in (lambda: stencil.slope(cells, 1.0, "miles"), lambda: stencil.gradients(cells, 1.0, "fifth"), lambda: stencil.local_relief(cells, 0)):
        with pytest.raises(ValueError):
            call()


def test_tiles_cover_each_cell_once(spark):
    cells = grid_of(spark, [[0] * 10] * 10)
    h = grid.haloed(cells, 4, 6)
    assert h.where("is_core").count() == 100
    one = h.where("tile_r = 1 AND tile_c = 1")
    assert one.count() == 100
