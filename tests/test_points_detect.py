from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurian.operators import detect, graph, points


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


def site(seed=19):
    rng = np.random.default_rng(seed)
    ground = np.c_[rng.uniform(0, 30, (1500, 2)), np.zeros(1500)]
    ground[:, 2] = 0.02 * ground[:, 0] + 1.0 * np.exp(-((ground[:, 0] - 15) ** 2 + (ground[:, 1] - 15) ** 2) / 20)
    tree = np.c_[rng.uniform(0, 30, (300, 2)), rng.uniform(4, 8, 300)]
    return np.vstack([ground, tree])


def test_gap_stays_nodata(spark):
    rng = np.random.default_rng(3)
    xyz = np.vstack([np.c_[rng.uniform(0, 5, (200, 2)), np.ones(200)], np.c_[rng.uniform(25, 30, (200, 2)), np.ones(200)]])
    g = points.grid_idw(cloud(spark, xyz), 1.0, 3.0)
    assert g.where("z IS NULL").count() > 0
    assert g.selectExpr("min(z)", "max(z)").first() == pytest.approx((1.0, 1.0))


def test_grid_limits(spark):
    with pytest.raises(ValueError):
        points.grid_idw(cloud(spark, [(0, 0, 0), (1e6, 1, 0)]), 1.0)
    with pytest.raises(ValueError):
        points.grid_geometry(cloud(spark, []), 1.0)


@pytest.mark.parametrize("ground", [lambda p: points.ground_pmf(p), lambda p: points.ground_cloth(p)])
def test_ground_filters_drop_the_canopy(spark, ground):
    kept = {r.id for r in ground(cloud(spark, site())).select("id").collect()}
    assert sum(i >= 1500 for i in kept) < 60
    assert sum(i < 1500 for i in kept) > 1100


def test_outlier(spark):
    rng = np.random.default_rng(1)
    xyz = np.vstack([rng.uniform(0, 5, (200, 3)), [[2, 2, 60]]])
    found = {r.id for r in points.outliers(cloud(spark, xyz), 10.0).where("is_outlier").collect()}
    assert 200 in found and len(found) < 15


BOX = "id long, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"


def test_suppression_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(2)
    boxes = []
    for i in range(120):
        x, y = map(float, rng.uniform(0, 60, 2))
        boxes.append((i, x, y, x + 12, y + 10, float(np.round(rng.uniform(), 1)), int(i % 2)))
    # All in one group, by components, and (the largest ones) in rounds.
    found = [{r.id for r in detect.suppress(spark.createDataFrame(boxes, BOX), 0.4, 16.0, most).collect()} for most in (1 << 20, 40, 4)]
    kept = found[0]
    assert found[0] == found[1] == found[2]

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        return 0 if w < 0 or h < 0 else w * h / (2 * 120 - w * h)

    want: list = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(k, b) < 0.4 for k in want if k[6] == b[6]):
            want.append(b)
    assert kept == {b[0] for b in want}


def test_suppression_of_a_crowded_field_makes_few_comparisons(spark):
    """Many boxes on few places, equal ones too: only those that stay are compared, and tiles of any size agree with the sequential rule."""
    import time

    rng = np.random.default_rng(5)
    n = 4000
    x, y, w, h = rng.integers(0, 30, n) / 1.0, rng.integers(0, 30, n) / 1.0, 4.0 + rng.integers(0, 3, n), 4.0 + rng.integers(0, 3, n)
    boxes = [(i, *map(float, (x[i], y[i], x[i] + w[i], y[i] + h[i], rng.integers(0, 50) / 50)), i % 2) for i in range(n)]
    want: list = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        near = np.array([k[1:5] for k in want if k[6] == b[6]]).reshape(-1, 4)
        wide, high = np.minimum(near[:, 2], b[3]) - np.maximum(near[:, 0], b[1]), np.minimum(near[:, 3], b[4]) - np.maximum(near[:, 1], b[2])
        both = np.clip(wide, 0, None) * np.clip(high, 0, None)
        if not (both / ((near[:, 2] - near[:, 0]) * (near[:, 3] - near[:, 1]) + (b[3] - b[1]) * (b[4] - b[2]) - both) >= 0.45).any():
            want.append(b)
    d = spark.createDataFrame(boxes, BOX)
    assert {r.id for r in detect.suppress(d, 0.45).collect()} == {b[0] for b in want}
    assert {r.id for r in detect.suppress(d, 0.45, None, 1000).collect()} == {b[0] for b in want}
    # A row without a place has no rivals.
    assert detect.suppress(spark.createDataFrame([(1, None, 0.0, 4.0, 4.0, 0.9, 0), (2, 0.0, 0.0, 4.0, 4.0, 0.8, 0), (3, 0.0, 0.0, 4.0, 4.0, 0.7, 0)], BOX)).count() == 2
    # As many boxes at one place would be 800 million pairs.
    one = spark.range(40_000).selectExpr("id", "id % 2 / 4.0D AS x1", "0D AS y1", "9D AS x2", "9D AS y2", "(id * 7919) % 40009 / 40009D AS confidence", "1 AS class_id")
    began = time.time()
    assert detect.suppress(one, 0.45).count() == 1 and time.time() - began < 30


def test_polygons(spark):
    cells = [[0] * 40 for _ in range(40)]
    for r in range(5, 15):
        for c in range(5, 15):
            cells[r][c] = 1
    for r in range(25, 33):
        for c in range(25, 33):
            cells[r][c] = 2
    cells[0][39] = 1
    labels = spark.createDataFrame([(r, c, cells[r][c], 0.75) for r in range(40) for c in range(40)], "r long, c int, label int, confidence double")
    assert detect.polygons(labels, 1.0, 10).count() == 2
    found = sorted((r.class_id, r.cell_count, r.area, r.mean_confidence) for r in detect.polygons(labels, 1.0, 1).collect())
    assert found == [(1, 1, 1.0, 0.75), (1, 100, 100.0, 0.75), (2, 64, 64.0, 0.75)]


def test_segmentation_and_names(spark):
    d = spark.createDataFrame([(0, 0, [0.0, 5.0]), (0, 1, [0.1, 0.0]), (0, 2, [2.0])], "r long, c int, logits array<double>")
    got = [r.label for r in detect.decode_segmentation(d, 0.8).orderBy("c").collect()]
    assert got == [1, 0, 1]
    from pyspark.sql import functions as F

    assert [r[0] for r in spark.createDataFrame([(0,), (5,), (-1,)], "k int").select(detect.class_name(["a"], F.col("k"))).collect()] == ["a", "class_5", "class_-1"]


def rings_of(wkt):
    inner = wkt.removeprefix("POLYGON ((").removesuffix("))")
    return [[tuple(int(v) for v in p.split()) for p in ring.split(", ")] for ring in inner.split("), (")]


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def cells_of(rings, rows, cols):
    """Cells whose centre a ray to the left crosses an odd number of sides for."""
    out = set()
    for r in range(rows):
        walls = sorted(a[0] for ring in rings for a, b in zip(ring, ring[1:], strict=False) if a[0] == b[0] and min(a[1], b[1]) <= r < max(a[1], b[1]))
        out |= {(r, c) for c in range(cols) if sum(x <= c for x in walls) % 2}
    return out


def regions_of(labels):
    seen, out = set(), []
    for start, k in labels.items():
        if not k or start in seen:
            continue
        todo, region = [start], {start}
        while todo:
            r, c = todo.pop()
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if p not in region and labels.get(p) == k:
                    region.add(p)
                    todo.append(p)
        seen |= region
        out.append((k, region))
    return out


def test_shapes_with_holes_and_diagonal_contacts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    labels = {(r, c): int(rng.choice([0, 1, 1, 2])) for r in range(24) for c in range(24)}
    # A ring around a ring around a block, and a ring that closes at a corner only.
    for r in range(15):
        for c in range(15):
            depth = min(r, c, 14 - r, 14 - c)
            labels[(r, c + 24)] = (2, 1, 1, 0, 2, 0, 1, 1)[depth]
    for r, c in ((16, 25), (16, 26), (17, 25), (18, 25), (18, 26), (18, 27), (17, 28), (16, 28), (15, 28), (15, 27), (15, 26), (15, 25)):
        labels[(r, c)] = 1
    d = spark.createDataFrame([(r, c, k, 0.5) for (r, c), k in labels.items()], "r long, c int, label int, confidence double")
    cuts = []
    real = detect.cut
    monkeypatch.setattr(detect, "cut", lambda df: cuts.append(1) or real(df))
    got = detect.shapes(d, 1.0, 1).collect()
    want = sorted((k, sorted(cells)) for k, cells in regions_of(labels))
    shown = []
    for g in got:
        rings = rings_of(g.wkt)
        assert signed(rings[0]) > 0 and all(signed(r) < 0 for r in rings[1:]) and g.holes == len(rings) - 1
        assert sum(map(signed, rings)) == g.cell_count == g.area
        assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 for r in rings), "a ring runs through a point once"
        shown.append((g.class_id, sorted(cells_of(rings, 40, 40))))
    assert sorted(shown) == want and max(g.holes for g in got) >= 2
    longest = max(len(r) for g in got for r in rings_of(g.wkt))
    assert len(cuts) <= 4 + 2 + np.log2(longest), "rounds grow with the logarithm of the longest ring"
    small = detect.shapes(d, 0.25, 1, (100.0, 0.5, 0.0, 200.0, 0.0, -0.5)).where("cell_count = 1").first()
    pts = [tuple(map(float, p.split())) for p in small.wkt.removeprefix("POLYGON ((").removesuffix("))").split(", ")]
    assert signed(pts) == 0.25
    assert detect.shapes(d.where("label = 9"), 1.0, 1).count() == 0


def test_shapes_of_any_tiling_and_rounds_that_hold_no_ring_of_one_tile(spark, monkeypatch):
    rng = np.random.default_rng(3)
    labels = {(r - 7, c): int(rng.choice([0, 1, 1, 2])) for r in range(30) for c in range(22)}
    # One band that winds through all tiles, and a frame around everything.
    labels |= {(r - 7, c + 30): int(r % 4 == 0 or c == (20 if r % 8 < 4 else 0)) for r in range(30) for c in range(21)}
    labels |= {(r - 9, c - 2): 2 for r in range(34) for c in range(58) if r in (0, 33) or c in (0, 57)}
    d = spark.createDataFrame([(r, c, k, 0.5) for (r, c), k in labels.items()], "r long, c int, label int, confidence double")
    cuts = []
    real = detect.cut
    monkeypatch.setattr(detect, "cut", lambda df: cuts.append(df) or real(df))
    seen = lambda found: sorted((x.class_id, x.cell_count, x.holes, x.wkt) for x in found.collect())
    whole = seen(detect.shapes(d, 1.0, 1, tile=1000))
    # A ring of more than 64 corners took seven rounds; its chains lie in the four tiles that meet at the origin.
    assert max(g[3].count(",") for g in whole) > 64 and len(cuts) <= 4 + 3, "rounds grow with the tiles that a ring passes through"
    assert sorted((k, n) for k, n, *_ in whole) == sorted((k, len(cells)) for k, cells in regions_of(labels))
    assert seen(detect.shapes(d, 1.0, 1, tile=5)) == whole


def test_components_by_blocks_leave_the_rounds_what_joins_blocks(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(49, 50), (310, 305), (305, 301), (400, 7), (500, 490)]
    d = spark.createDataFrame(edges, "a long, b long")
    want = {r.node: r.root for r in graph.components(d).collect()}
    rounds = []
    real = graph.components
    monkeypatch.setattr(graph, "components", lambda e: rounds.append(e.count()) or real(e))
    got = graph.block_components(d, lambda n: F.floor(n / 10)).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert rounds[0] < len(edges) / 5


def test_openings_of_any_tiling_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 3, (23, 31))
    z[rng.random(z.shape) < 0.3] = np.nan
    cells = spark.createDataFrame([(int(r) - 4, int(c) + 9, float(z[r, c])) for r, c in np.argwhere(~np.isnan(z))], "r long, c int, z double")
    for half, tile in ((1, 512), (3, 8), (9, 7), (40, 16)):
        want = z
        for f in (np.nanmin, np.nanmax):
            for turn in (True, False):
                a = want.T if turn else want
                a = np.array([[f(a[max(0, i - half) : i + half + 1, j]) if not np.isnan(a[i, j]) else np.nan for j in range(a.shape[1])] for i in range(a.shape[0])])
                want = a.T if turn else a
        want = {(r - 4, c + 9): want[r, c] for r, c in np.argwhere(~np.isnan(z)).tolist()}
        assert {(r.r, r.c): r.opened for r in points.opening(cells, half, tile=tile).collect()} == want
    cloud_ = cloud(spark, site())
    kept = [{r.id for r in points.ground_pmf(cloud_, tile=t).select("id").collect()} for t in (512, 16, 5)]
    assert kept[0] == kept[1] == kept[2]


def test_wide_windows_cost_no_more(spark):
    import time

    z = np.random.default_rng(1).normal(0, 1, (1500, 1500))

    def seconds(half):
        best = []
        for _ in range(5):
            began = time.perf_counter()
            points._opened(z, half)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(50) <= 1.3 * seconds(2)


def test_a_long_chain_of_boxes_needs_no_round_a_link(spark):
    import time

    # Each box overlaps the next by more than the limit; confidences fall along the chain.
    boxes = [(i, 4.0 * i, 0.0, 4.0 * i + 10, 10.0, 1.0 - i / 2000, 0) for i in range(1000)]
    began = time.time()
    kept = sorted(r.id for r in detect.suppress(spark.createDataFrame(boxes, BOX), 0.4).select("id").collect())
    assert kept == list(range(0, 1000, 2)) and time.time() - began < 15


def test_stray_points_move_the_rim_of_the_cloud_only(spark):
    rng = np.random.default_rng(7)
    n = 40_000
    xyz = np.vstack([np.c_[rng.uniform(0, 200, (n, 2)), rng.normal(0, 0.3, n)], [[2000, 40, 0], [100, 100, 900], [-3000, -10, 5]]])
    p = cloud(spark, xyz)
    stray = p.where(f"id >= {n}")
    side = 4.0
    tiles = points._nearest_tiles(p, stray.where(f"id = {n}"), side, 8).select("tx", "ty").distinct()
    moved = p.selectExpr("id", f"floor(x / {side}) AS tx", f"floor(y / {side}) AS ty").join(tiles, ["tx", "ty"], "left_semi").count()
    assert 9 <= moved < 0.02 * n
    got = {r.id: r.mean_distance for r in points.outliers(p, 4.0).collect()}
    for i in (n, n + 1, n + 2, 0, 17):
        far = np.sort(np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1)))[1:9]
        assert got[i] == pytest.approx(far.mean())
    assert {r.id for r in points.outliers(p, 4.0).where("is_outlier").collect()} >= {n, n + 1, n + 2}


def test_crowded_clouds_are_gridded_without_tiles(spark, monkeypatch):
    """Crowded cells, sparse ones and empty ones find the same points in rounds as in tiles, and no tile reaches Python."""
    rng = np.random.default_rng(11)
    xy = np.vstack([rng.uniform(0, 8, (3000, 2)), rng.uniform(8, 30, (60, 2)), [[60.0, 60.0]], rng.integers(0, 9, (200, 2)).astype(float)])
    p = cloud(spark, np.c_[xy, rng.normal(0, 1, len(xy))])
    for radius, nearest in ((None, 12), (0.7, 3)):
        tiles = {(r.r, r.c): r.z for r in points.grid_idw(p, 2.0, radius, nearest).collect()}
        with monkeypatch.context() as m:
            m.setattr(points, "TILE_POINTS", 100)
            d = points.grid_idw(p, 2.0, radius, nearest)
            assert "Pandas" not in d._jdf.queryExecution().executedPlan().toString()
            rounds = {(r.r, r.c): r.z for r in d.collect()}
        assert tiles.keys() == rounds.keys() and any(v is None for v in tiles.values())
        assert all(rounds[k] == (None if v is None else pytest.approx(v)) for k, v in tiles.items())


def test_ground_surface_of_a_crowded_cloud_holds_no_tile(spark, monkeypatch):
    rng = np.random.default_rng(12)
    p = cloud(spark, np.c_[rng.uniform(0, 12, (900, 2)), rng.normal(0, 0.1, 900)])
    whole = {(r.r, r.c): r.z for r in points.ground_surface(p, 2.0).collect()}
    monkeypatch.setattr(points, "TILE_POINTS", 100)
    d = points.ground_surface(p, 2.0)
    assert "Pandas" not in d._jdf.queryExecution().executedPlan().toString()
    assert {(r.r, r.c): r.z for r in d.collect()} == pytest.approx(whole)


def test_outliers_of_a_crowd_meet_small_tiles(spark, monkeypatch):
    """No tile holds more points than the bound while the neighbours are near; mean distances are those of all pairs."""
    rng = np.random.default_rng(13)
    xyz = np.vstack([np.c_[rng.uniform(0, 8, (1500, 2)), rng.normal(0, 0.1, 1500)], np.c_[rng.uniform(0, 8, (12, 2)), np.full(12, 60.0)]])
    monkeypatch.setattr(points, "TILE_POINTS", 600)
    reaches, rater = [], points._rater
    monkeypatch.setattr(points, "_rater", lambda k, reach: reaches.append(reach) or rater(k, reach))
    got = {r.id: r.mean_distance for r in points.outliers(cloud(spark, xyz), 4.0).collect()}
    assert max(reaches) < 4.0
    far = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)), axis=1)[:, 1:9].mean(axis=1)
    assert all(got[i] == pytest.approx(far[i]) for i in range(len(xyz)))
