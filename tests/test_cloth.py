from __future__ import annotations

import numpy as np
import pytest

from tellurian.operators import cloth, points


def plain_cloth(height, rigidness, time_step, slope_smooth):
    """The filter on a whole array, pair by pair."""
    rows, cols = height.shape
    floor = np.where(np.isnan(height), np.nanmin(height), height)
    now = np.full(height.shape, np.nanmax(height) + 1.0)
    last, moving, taken = now.copy(), np.ones(height.shape, bool), 0
    for taken in range(1, cloth.ROUNDS + 1):
        fall = [[(now[r, c] - last[r, c]) * 0.99 - 0.2 * time_step * time_step if moving[r, c] else 0.0 for c in range(cols)] for r in range(rows)]
        last = now.copy()
        now = now + np.array(fall)
        for _ in range(rigidness):
            for dr, dc in ((1, 0), (0, 1)):
                old = now.copy()
                # Pairs along an axis are pulled one after the other, all by the gaps before the pass.
                for side in (0, 1):
                    for r in range(rows - dr):
                        for c in range(cols - dc):
                            a, b = (r, c), (r + dr, c + dc)
                            gap = old[b] - old[a]
                            if moving[a] and moving[b]:
                                gap = gap / 2
                            if side == 0 and moving[a]:
                                now[a] += gap * 0.5
                            if side == 1 and moving[b]:
                                now[b] -= gap * 0.5
        hit = now <= floor
        now[hit] = floor[hit]
        moving &= ~hit
        if np.abs(now - last).max() < cloth.STILL:
            break
    while slope_smooth:
        down = []
        for r in range(rows):
            for c in range(cols):
                near = [(r + i, c + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= r + i < rows and 0 <= c + j < cols]
                if moving[r, c] and now[r, c] - floor[r, c] < cloth.STEP and any(not moving[p] and abs(floor[p] - floor[r, c]) < cloth.STEP for p in near):
                    down.append((r, c))
        for p in down:
            now[p], moving[p] = floor[p], False
        if not down:
            break
    return now, taken


def nodes_of(spark, height, r0=-7, c0=100):
    return spark.createDataFrame([(r + r0, c + c0, float(height[r, c])) for r, c in np.argwhere(~np.isnan(height)).tolist()], "r long, c long, h double")


def heights(rows=14, cols=19, seed=5):
    rng = np.random.default_rng(seed)
    r, c = np.meshgrid(np.arange(rows), np.arange(cols), indexing="ij")
    h = -(0.3 * np.sin(c / 4) + 0.05 * r + np.where(rng.random((rows, cols)) < 0.2, rng.uniform(2, 5, (rows, cols)), 0))
    h[rng.random((rows, cols)) < 0.15] = np.nan
    h[0, 0] = h[-1, -1] = -1.0
    return h


@pytest.mark.parametrize(("rigidness", "smooth"), [(1, True), (3, False), (2, True)])
def test_any_tiling_equals_the_whole_raster(spark, rigidness, smooth):
    h = heights(seed=rigidness)
    want, rounds = plain_cloth(h, rigidness, 0.65, smooth)
    assert rounds < cloth.ROUNDS
    for tile in (256, 8, 5):
        got = {(r.r + 7, r.c - 100): r.cloth for r in cloth.draped(nodes_of(spark, h), rigidness, 0.65, smooth, tile).collect()}
        assert len(got) == h.size
        assert [got[k] for k in np.ndindex(h.shape)] == [want[k] for k in np.ndindex(h.shape)], tile


def test_ground_points_of_three_tilings_are_the_same(spark):
    rng = np.random.default_rng(2)
    n = 6000
    x, y = rng.uniform(0, 60, n), rng.uniform(0, 60, n)
    z = 2 * np.sin(x / 9) + 0.03 * y + np.where(np.arange(n) % 5 == 0, rng.uniform(3, 7, n), 0)
    cloud = spark.createDataFrame([*[(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, z, strict=True))], (n, None, 1.0, 1.0)], "id long, x double, y double, z double")
    kept = [{r.id for r in points.ground_cloth(cloud, tile=t).select("id").collect()} for t in (256, 30, 17)]
    assert kept[0] == kept[1] == kept[2]
    assert sum(i % 5 == 0 for i in kept[0]) < 0.02 * n and sum(i % 5 != 0 for i in kept[0]) > 0.75 * n
    assert points.ground_cloth(cloud.limit(0)).count() == 0


def test_groups_are_bounded(spark):
    """A tile and its margins are all that a task holds, however many nodes there are."""
    grid = cloth.Raster(0, 0, 10_000, 7_000, 256, 0.0, 1.0)
    margin = 256 // 2
    assert grid.tiles == 40 * 28
    for t in (0, 500, grid.tiles - 1):
        a, b, c, d = grid.box(t, margin)
        assert (b - a) * (d - c) <= (256 + 2 * margin) ** 2
