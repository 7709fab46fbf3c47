from __future__ import annotations

import numpy as np
import pytest

from tellurian.operators import change, project, warp
from tests.conftest import array_of, grid_of


def test_round_trips_and_known_distances():
    rng = np.random.default_rng(1)
    for zone in ("EPSG:32631", "EPSG:32731", "EPSG:3857", "EPSG:4326"):
        lon, lat = rng.uniform(-10, 16, 20_000), rng.uniform(-80, 84, 20_000)
        x, y = project.reproject_arrays(lon, lat, "EPSG:4326", zone)
        back = project.reproject_arrays(x, y, zone, "EPSG:4326")
        assert max(np.abs(back[0] - lon).max(), np.abs(back[1] - lat).max()) * 111_320 < 1e-3
    # Lengths of the meridian from the equator to 50 degrees and to the pole.
    y = project.reproject_arrays(np.array([3.0, 3.0]), np.array([50.0, 90.0]), "EPSG:4326", "EPSG:32631")[1] / 0.9996
    assert y == pytest.approx([5_540_847.042, 10_001_965.729], abs=1e-3)
    assert project.reproject_arrays(np.array([3.0]), np.array([0.0]), "EPSG:4326", "EPSG:32731") == (500_000, 10_000_000)
    with pytest.raises(ValueError, match="Unknown coordinate system"):
        project.system("EPSG:27700")


def test_scale_on_and_off_the_meridian():
    """A short step north is as long as the zone's scale says: 0.9996 on its meridian, 1 some 180 km off."""
    for off, scale in ((0.0, 0.9996), (180_000.0, 1.0)):
        lon, lat = project.reproject_arrays(np.full(2, 500_000 + off), np.array([3e6, 3e6 + 1000]), "EPSG:32631", "EPSG:4326")
        e2 = project.FLATTENING * (2 - project.FLATTENING)
        radius = project.AXIS * (1 - e2) / (1 - e2 * np.sin(np.radians(lat[0])) ** 2) ** 1.5
        across = project.AXIS / np.sqrt(1 - e2 * np.sin(np.radians(lat[0])) ** 2) * np.cos(np.radians(lat[0]))
        long = np.hypot(np.radians(lat[1] - lat[0]) * radius, np.radians(lon[1] - lon[0]) * across)
        assert 1000 / long == pytest.approx(scale, abs=2e-5)


def test_columns_equal_arrays(spark):
    xy = [(i, 300_000.0 + 7919 * i % 400_000, 4e6 + 104_729 * i % 3_000_000, "kept") for i in range(50)] + [(50, None, 5e6, "kept")]
    got = project.reproject(spark.createDataFrame(xy, "id long, x double, y double, lon string"), "EPSG:32633", "EPSG:32634").orderBy("id").collect()
    x, y = project.reproject_arrays(np.array([p[1] for p in xy[:50]]), np.array([p[2] for p in xy[:50]]), "EPSG:32633", "EPSG:32634")
    assert [r.x for r in got[:50]] == pytest.approx(x, abs=1e-6) and [r.y for r in got[:50]] == pytest.approx(y, abs=1e-6)
    assert got[50].x is None and got[0].lon == "kept"


def plain(source, where, rows, cols, how):
    """Each target cell from all source cells around its place."""
    weight, span = warp.KERNELS[how]
    wide = [max(1.0, s) for s in where.scales(rows, cols)]
    out = np.full((rows, cols), np.nan)
    for r in range(rows):
        for c in range(cols):
            p = [float(v[0]) for v in where.at(np.array([float(r)]), np.array([float(c)]))]
            at = [int(np.floor(v + 0.5)) for v in p]
            if not (0 <= at[0] < source.shape[0] and 0 <= at[1] < source.shape[1]) or np.isnan(source[at[0], at[1]]):
                continue
            if how == "nearest":
                out[r, c] = source[at[0], at[1]]
                continue
            w = np.outer(*[np.where(np.abs(np.arange(n) - v) <= span * k, weight(np.abs(np.arange(n) - v) / k), 0) for n, v, k in zip(source.shape, p, wide, strict=True)])
            w[np.isnan(source)] = 0
            out[r, c] = np.nansum(w * source) / w.sum()
    return out


def surface(rows, cols, seed=3):
    z = np.random.default_rng(seed).normal(10, 3, (rows, cols))
    z[2:4, 3:6] = np.nan
    return z


def as_cells(spark, z):
    return grid_of(spark, [[None if np.isnan(v) else v for v in row] for row in z])


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic", "cubic_spline", "lanczos"])
def test_affine_maps_finer_and_ten_times_coarser(spark, monkeypatch, how):
    monkeypatch.setattr(warp, "TILE", 8)
    for z, where, rows, cols in ((surface(12, 14), warp.Affine((0.7, -1.2), (0.45, 0.3)), 22, 30), (surface(60, 80), warp.Affine((10.0, 4.5), (10.0, 3.0)), 6, 8), (surface(9, 9), warp.Affine((-1.0, 8.0), (1.0, 0.0)), 9, 9)):
        got = array_of(warp.warp(as_cells(spark, z), where, rows, cols, how), "z")
        np.testing.assert_allclose(got, plain(z, where, rows, cols, how), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("how", ["nearest", "bilinear", "lanczos"])
def test_reprojection_equals_a_loop_over_cells_in_any_tiling(spark, monkeypatch, how):
    z = surface(40, 40)
    where = warp.Reprojection((284_900.0, 12.0, 5_546_000.0, -12.0), "EPSG:32632", (714_900.0, 15.0, 5_546_050.0, -15.0), "EPSG:32631")
    want = plain(z, where, 30, 26, how)
    assert np.isnan(want).any() and (~np.isnan(want)).sum() > 100
    for tile in (256, 7):
        monkeypatch.setattr(warp, "TILE", tile)
        np.testing.assert_allclose(array_of(warp.warp(as_cells(spark, z), where, 30, 26, how), "z"), want, rtol=1e-9, atol=1e-9)


def test_surfaces_far_apart_or_empty(spark):
    z = as_cells(spark, surface(6, 6))
    geo = (500_000.0, 10.0, 4e6, -10.0)
    far = change.match_grid(z, geo, (500_000.0, 10.0, 6e6, -10.0), 5, 5, "bilinear", "EPSG:32631", "EPSG:32633")
    assert far.count() == 25 and far.where("z IS NOT NULL").count() == 0
    assert change.match_grid(z.limit(0), geo, geo, 5, 5).where("z IS NULL").count() == 25
    # The same system twice is no reprojection.
    np.testing.assert_allclose(array_of(change.match_grid(z, geo, geo, 6, 6, "bilinear", "epsg:32631", "EPSG:32631"), "z"), surface(6, 6))
    with pytest.raises(ValueError, match="Unknown resampling"):
        change.match_grid(z, geo, geo, 5, 5, "sinc")


def test_a_whole_plane_keeps_its_slope_across_zones(spark):
    """A plane over one zone's coordinates comes back as that plane from the next zone's grid."""
    new = (284_000.0, 20.0, 5_547_000.0, -20.0)
    r, c = np.meshgrid(np.arange(120), np.arange(120), indexing="ij")
    x, y = project.reproject_arrays(new[0] + (c + 0.5) * new[1], new[2] + (r + 0.5) * new[3], "EPSG:32632", "EPSG:32631")
    old = (714_900.0, 10.0, 5_545_900.0, -10.0)
    got = array_of(change.match_grid(as_cells(spark, (x - 714_900) * 0.01 + (y - 5_545_000) * 0.02), new, old, 40, 40, "bilinear", "EPSG:32632", "EPSG:32631"), "z")
    r, c = np.meshgrid(np.arange(40), np.arange(40), indexing="ij")
    assert got == pytest.approx((c + 0.5) * 0.1 + (900 - (r + 0.5) * 10) * 0.02, abs=1e-5)
