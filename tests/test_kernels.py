"""Kernels and helpers against brute force."""

from __future__ import annotations

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellurian.functions import records, text
from tellurian.operators import blend, change, detect, horizon, inference, nearest, points, quantiles, stencil
from tellurian.sources import files, reports
from tests.conftest import array_of, grid_of


def horizon_by_definition(sines, ahead, slack):
    """One ray, sample by sample: what counts, and what a spike takes with it."""
    top, i, n = 0.0, 0, len(sines)
    while i < n:
        if sines[i] > top:
            behind = sines[i + 1 : i + 1 + ahead]
            if i + ahead >= n or any(s >= sines[i] - slack for s in behind):
                top = sines[i]
            else:
                i += ahead
        i += 1
    return top


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 9), min_size=1, max_size=14), st.integers(0, 4), st.sampled_from([0.0, 0.1, 0.25]))
def test_horizon_without_spikes(heights, ahead, slack):
    sines = [h / 10 for h in heights]
    got = horizon.settled_horizon(np.array(sines)[:, None, None], ahead, slack)
    assert got[0, 0] == horizon_by_definition(sines, ahead, slack)


@pytest.mark.parametrize("reach", [0.5, 3.0, np.inf])
@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_nearest_points(reach, spread):
    rng = np.random.default_rng(5)
    x, y, z = np.r_[rng.normal(0, spread, 300), 500.0], np.r_[rng.normal(0, 1, 300), -80.0], rng.normal(0, 2, 301)
    cx, cy = np.r_[rng.normal(0, spread, 60), 900.0, -700.0], np.r_[rng.normal(0, 1, 60), 900.0, 3.0]
    q, at, d2 = nearest.nearest(x, y, z, cx, cy, 5, reach)
    for i in range(len(cx)):
        d = (x - cx[i]) ** 2 + (y - cy[i]) ** 2
        want = [k for k in np.lexsort((y, x, z, d)) if d[k] <= reach * reach][:5]
        assert at[q == i].tolist() == want and d2[q == i] == pytest.approx(d[want])
    q, at, d2 = nearest.nearest(x, y, z, x, y, 4, reach, z, skip_self=True, pairs=500)
    for i in range(len(x)):
        d = (x - x[i]) ** 2 + (y - y[i]) ** 2 + (z - z[i]) ** 2
        d[i] = np.inf
        assert d2[q == i] == pytest.approx(np.sort(d[d <= reach * reach])[:4])


@pytest.mark.parametrize("values", [[3.0], [1.0, 1.0, 1.0], [0.0, 1e9, 1e-9, 5.0], np.random.default_rng(1).normal(0, 1, 3000).tolist(), [float(i % 7) for i in range(900)]])
def test_quantiles(spark, values, monkeypatch):
    monkeypatch.setattr(quantiles, "FETCH", 5)
    monkeypatch.setattr(quantiles, "BINS", 16)
    d = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    shares = (0.0, 0.02, 0.5, 0.77, 0.98, 1.0)
    assert quantiles.quantiles(d, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert quantiles.quantiles(d.where("false"), "v", shares) is None


def test_stretches_of_nothing(spark):
    d = grid_of(spark, [[None, None]])
    assert blend.deviation_stretch(d, "z") == (0.0, 0.0)
    assert {r.byte for r in blend.percentile_stretch(d, "z").collect()} == {24}


@pytest.mark.parametrize("how", ["bilinear", "cubic", "cubic_spline", "lanczos"])
def test_resamplers(spark, how):
    flat = grid_of(spark, [[7.0] * 9 for _ in range(8)])
    for scale, offset in ((0.4, -0.3), (1.0, 0.0), (2.3, 0.65)):
        out = change.resample(flat, how, 3, 3, (scale, offset), (scale, offset)).select("z").collect()
        assert all(r.z == pytest.approx(7.0) for r in out)
    ramp = array_of(change.resample(grid_of(spark, [[float(c) for c in range(20)] for _ in range(9)]), how, 9, 20, (1.0, 0.0), (1.0, 0.25)), "z")
    assert ramp[4, 5:14] == pytest.approx(np.arange(5, 14) + 0.25, abs=0.02)
    holed = grid_of(spark, [[1.0, 1.0, None, 1.0, 1.0]])
    same = {r.c: r.z for r in change.resample(holed, how, 1, 6, (1.0, 0.0), (1.0, 0.0)).collect()}
    assert same[2] is None and same[5] is None and same[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        change.resample(flat, "wave", 1, 1, (1.0, 0.0), (1.0, 0.0))


def test_surfaces_of_other_grids(spark):
    old = grid_of(spark, [[float(r + c) for c in range(12)] for r in range(12)])
    new = grid_of(spark, [[2.0 * (r + c) + 5.5 for c in range(5)] for r in range(5)])
    geo_old, geo_new = (0.0, 1.0, 0.0, -1.0), (1.0, 2.0, -1.0, -2.0)
    diff = change.difference_on_grid(old, new, geo_old, geo_new, 1.0)
    inner = diff.where("r BETWEEN 2 AND 9 AND c BETWEEN 2 AND 9")
    assert inner.count() == 64 and all(r.dod == pytest.approx(2.5) and r["mask"] == 2 for r in inner.collect())
    assert {r["mask"] for r in diff.where("r = 0").collect()} == {255}
    near = array_of(change.match_grid(new, geo_new, geo_old, 12, 12, "nearest"), "z")
    assert near[1, 1] == 5.5 and near[2, 3] == 7.5 and np.isnan(near[0, 0])


def test_outlines_close_and_enclose_their_cells(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, (12, 15))
    d = spark.createDataFrame([(r, c, int(labels[r, c])) for r in range(12) for c in range(15)], "r long, c int, label int")
    segments = detect.outlines(d).collect()
    for label in (1, 2):
        mine = [(s.x1, s.y1, s.x2, s.y2) for s in segments if s.label == label]
        # The shoelace formula over all rings, and as many segments that begin as that end in a corner.
        assert abs(sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in mine)) / 2 == (labels == label).sum()
        begins, ends = sorted((x, y) for x, y, _, _ in mine), sorted((x, y) for _, _, x, y in mine)
        assert begins == ends


def test_one_session_a_worker_and_run(spark, tmp_path):
    z = [[float((r * c) % 7) for c in range(16)] for r in range(16)]

    def counted(level, folder):
        def build():
            import os
            import uuid

            open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
            return lambda x: [np.full((1, 1, *x.shape[2:]), level)]

        return build

    d = grid_of(spark, z).coalesce(1)
    for level, label in ((9.0, 1), (-9.0, 0), (9.0, 1)):
        folder = tmp_path / f"run{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        got = inference.segment(d, counted(level, str(folder)), 0.5, tile=4, overlap=0, size=(4, 4))
        assert {r.label for r in got.collect()} == {label}
        made = [f.name.split("-")[0] for f in folder.iterdir()]
        assert made and len(made) == len(set(made)) < 16


def test_layouts_of_detection_models():
    corners = np.array([[1, 2, 3, 4, 0.9, 1], [5, 6, 7, 8, 0.2, 0]], float)
    assert inference.model_boxes([corners[None]]).tolist() == corners.tolist()
    centres = np.array([[10, 20, 4, 6, 0.5, 0.1, 0.8, 0.3]])
    assert inference.model_boxes([centres[None]]).tolist() == [[8, 17, 12, 23, 0.4, 1]]
    several = [np.array([1]), corners[None, :, :4], corners[None, :, 4], corners[None, :, 5]]
    assert inference.model_boxes(several).tolist() == corners[:1].tolist()
    with pytest.raises(ValueError):
        inference.model_boxes([np.zeros((2, 2))])


def test_sparse_clouds_have_neighbours_too(spark):
    xyz = [(i, float(i % 5), float(i // 5), 0.0) for i in range(50)] + [(50, 900.0, 900.0, 0.0), (51, -4000.0, 0.0, 0.0)]
    got = {r.id: r.mean_distance for r in points.outliers(spark.createDataFrame(xyz, "id long, x double, y double, z double"), 1.5).collect()}
    for i, x, y, z in xyz:
        d = sorted(np.sqrt((x - a) ** 2 + (y - b) ** 2) for j, a, b, _ in xyz if j != i)[:8]
        assert got[i] == pytest.approx(np.mean(d))
    lone = points.outliers(spark.createDataFrame(xyz[:1], "id long, x double, y double, z double"), 1.0).first()
    assert lone.mean_distance is None and lone.is_outlier
    ordinary = points.without_outliers(spark.createDataFrame(xyz, "id long, x double, y double, z double"), 1.5)
    assert {51} <= set(range(52)) - {r.id for r in ordinary.collect()} and ordinary.first()["classification"] == 1


def test_surface_from_las(spark, tmp_path):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 20, 900), rng.uniform(0, 20, 900)
    (tmp_path / "a.las").write_bytes(files.las_bytes(x, y, 5 + 0.1 * x, np.full(900, 2)))
    got = array_of(files.las_surface(spark, str(tmp_path / "a.las"), 2.0, "classified"), "z")
    assert got[2:8, 2:8] == pytest.approx(np.tile(5 + 0.1 * (np.arange(2, 8) * 2 + 0.9), (6, 1)), abs=0.25)
    (tmp_path / "b.las").write_bytes(files.las_bytes(x[:9], y[:9], x[:9], np.full(9, 2)))
    with pytest.raises(ValueError, match="ground points are too few"):
        files.las_surface(spark, str(tmp_path / "b.las"), 2.0)
    packed = bytearray(files.las_bytes(x[:2], y[:2], x[:2], np.full(2, 2)))
    packed[104] |= 128
    (tmp_path / "c.las").write_bytes(bytes(packed))
    with pytest.raises(Exception, match="compressed"):
        files.read_las(spark, str(tmp_path / "c.las")).count()
    with pytest.raises(ValueError, match="Unknown ground filter"):
        points.ground_surface(files.read_las(spark, str(tmp_path / "a.las")), 1.0, "none")


def test_sidecars_and_packages(spark, tmp_path):
    cells = grid_of(spark, [[1.0, 2.0]])
    record = records.provenance(cells, "EPSG:27700", 1.0, "svf", {"radius": 10})
    path = files.write_sidecar(record, f"file://{tmp_path}/out")
    assert files.read_sidecar(spark, f"file://{tmp_path}/out")["algorithm"] == files.read_sidecar(spark, path)["algorithm"] == "svf"
    assert files.write_sidecar(record.select(F.lit(1).alias("other")), f"file://{tmp_path}/bad") is None
    with pytest.raises(FileNotFoundError):
        files.read_sidecar(spark, f"file://{tmp_path}/none")
    (tmp_path / "x.provenance.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.read_sidecar(spark, f"file://{tmp_path}/x.provenance.json")
    finds = spark.createDataFrame([(1.0, 2.0, "a1", "bank", "high")], "x double, y double, anomaly_id string, feature_type string, confidence string")
    made = files.field_package(cells, finds, f"file://{tmp_path}/pack", "../My site")
    assert spark.read.parquet(made["survey"]).first()["wkt"] == "POINT (1.000 2.000)" and "My_site" in made["project"]
    with pytest.raises(Exception, match="(?i)exists"):
        files.field_package(cells, finds, f"file://{tmp_path}/pack", "../My site")
    with pytest.raises(ValueError, match="confidence"):
        files.field_package(cells, finds.drop("confidence"), f"file://{tmp_path}/other", "s")


def test_small_records(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(text.azimuths(F.lit("315, , 45.5,"))) == [315.0, 45.5]
    with pytest.raises(Exception, match="Not an azimuth"):
        one(text.azimuths(F.lit("315, west")))
    assert records.label_names('["a", "b"]') == ["a", "b"] and records.label_names('{"2": "x", "0": "y", "k": 1}') == ["y", "class_1", "x"]
    assert records.label_names("no json") == [] == records.label_names("3")
    assert records.plain({1: (np.float32(2), float("nan"), {"b", "a"}), "k": None}) == {"1": [2.0, None, ["a", "b"]], "k": None}
    json.dumps(records.plain({"a": np.int64(3), "b": object}))
    assert records.label_names('{"999999999": "far", "1": "x"}') == ["class_0", "x"]
    assert blend.e4mstp_halo() == 100 and blend.e4mstp_halo(windows=(3, 5, 8)) == 50 and blend.e4mstp_halo(windows=(3, 5, 8), far=10, ring=(2.0, 60.0)) == 61
    cells = grid_of(spark, [[1.0, 2.0], [3.0, None]])
    for wrong in ({"ring": (20.0, 20.0)}, {"windows": (50, 20, 100)}, {"directions": 3}, {"observer": 0.0}, {"radius": 0}, {"tiles": 10}):
        with pytest.raises(ValueError):
            blend.e4mstp_of(cells, 1.0, **wrong)
    row = records.preflight(grid_of(spark, [[1.0, 200.0, None]]), 0.5).first().asDict()
    shown = records.preflight_text(row, "a.tif", "EPSG:27700", ("no CRS",))
    assert "grid: 3 x 1 cells, 3 in all" in shown and "- no CRS" in shown and "preset: upland_steep" in shown
    assert {r.name for r in records.capabilities(spark).where("available").collect()} >= {"array kernels", "columnar exchange"}
    assert "Classification[1:1]" in reports.outlier_pipeline("a", "b")


def test_bookmarks(spark):
    empty = spark.createDataFrame([], "name string, x_min double, y_min double, x_max double, y_max double, crs string, at timestamp")
    b = records.saved_bookmark(empty, " fort ", (0, 0, 1, 1), "EPSG:27700", "2024-01-01 00:00:00")
    b = records.saved_bookmark(b, "fort", (0, 0, 2, 2), "EPSG:27700", "2024-01-02 00:00:00")
    assert [(r.name, r.x_max) for r in b.collect()] == [("fort", 2.0)]
    b = records.renamed_bookmark(b, "fort", "camp", "2024-01-03 00:00:00")
    assert [r.name for r in b.collect()] == ["camp"] and records.removed_bookmark(b, "camp").count() == 0
    for call in (lambda: records.renamed_bookmark(b, "fort", "x", "2024-01-03"), lambda: records.saved_bookmark(b, " ", (0, 0, 1, 1), "c", "2024-01-03"), lambda: records.saved_bookmark(b, "n", (1, 0, 0, 1), "c", "2024-01-03")):
        with pytest.raises(ValueError):
            call()


def test_bookmarks_are_fifty_at_most(spark):
    empty = spark.createDataFrame([], "name string, x_min double, y_min double, x_max double, y_max double, crs string, at timestamp")
    many = spark.range(60).select(F.concat(F.lit(" b"), "id").alias("name"), *[F.lit(v).alias(n) for n, v in (("x_min", 0.0), ("y_min", 0.0), ("x_max", 1.0), ("y_max", 1.0))], F.lit("EPSG:1").alias("crs"), F.timestamp_seconds("id").alias("at"))
    assert {r.name for r in records.saved_bookmarks(empty, many).collect()} == {f"b{i}" for i in range(10, 60)}


def test_a_surface_needs_ten_ground_points(spark):
    rows = [(i, float(i), 0.0, 1.0, 2 if i < 3 else 1) for i in range(12)]
    with pytest.raises(ValueError, match="3 ground points are too few"):
        points.ground_surface(spark.createDataFrame(rows, "id long, x double, y double, z double, classification int"), 1.0, "classified")


def test_windows_keep_their_digits_on_long_lines(spark):
    """A constant surface shows no deviation, however long its lines are."""
    flat = spark.range(200_000).select(F.lit(0).cast("long").alias("r"), F.col("id").cast("int").alias("c"), F.lit(1234.567).alias("z"))
    d = stencil.deviation(flat, 5, "dev").agg(F.max(F.abs("dev"))).first()[0]
    assert d == 0.0


def test_batch_equals_the_products_alone(spark):
    rng = np.random.default_rng(6)
    cells = grid_of(spark, [[None if (r, c) == (3, 4) else float(rng.normal(50, 9)) for c in range(26)] for r in range(24)])
    few = {"windows": (2, 4, 7), "e4mstp_settings": {"windows": (1, 3, 6), "far": 12}, "vat_radii": (6, 5), "trend": 4}
    scans, cuts = [], []
    real_layers, real_cut = horizon.layers, blend.cut
    with pytest.MonkeyPatch.context() as m:
        m.setattr(horizon, "layers", lambda *a, **k: scans.append(a[2]) or real_layers(*a, **k))
        m.setattr(blend, "cut", lambda d: cuts.append(1) or real_cut(d))
        whole = blend.batch(cells, 1.0, radius=6, **few)
    assert len(scans) == 1 and len(cuts) == 1 and whole.columns[2:] == [c for n in blend.BATCH for c in blend.BATCH[n]]
    # Openness of radius 10 and its like are not made twice; local dominance serves three products.
    assert len(scans[0]) == len({repr(v) for v in scans[0].values()}) == 9
    alone = {
        "vat": blend.vat(cells, 1.0, 6, 5), "red_relief": blend.red_relief(cells, 1.0, 4), "e4mstp": blend.e4mstp_of(cells, 1.0, windows=(1, 3, 6), far=12), "pca": blend.pca_of(cells, 1.0, 6),
        "mstp": stencil.mstp(cells, 2, 4, 7), "asvf": horizon.anisotropic_sky_view(cells, 1.0, radius=6), "slrm": stencil.local_relief(cells, 4), "openness": horizon.openness(cells, 1.0, radius=6),
    }
    for name, one in alone.items():
        for a, b in zip(blend.BATCH[name], one.columns[2:], strict=True):
            np.testing.assert_allclose(array_of(whole, a), array_of(one, b), atol=1e-9, err_msg=name)


def test_batch(spark):
    cells = grid_of(spark, [[float((r * 7 + c * 3) % 11) for c in range(14)] for r in range(14)])
    got = blend.batch(cells, 1.0, ("svf", "slope"), radius=4).orderBy("r", "c").collect()
    alone = horizon.sky_view_factor(cells, 1.0, radius=4).orderBy("r", "c").collect()
    assert got[0].asDict().keys() == {"r", "c", "svf", "slope"} and [r.svf for r in got] == pytest.approx([r.svf for r in alone])
    with pytest.raises(ValueError):
        blend.batch(cells, 1.0, ("aspect",))


def test_cut_tables_are_released(spark):
    from tellurian.operators import lineage

    lineage.release(spark)
    table = lineage.cut(spark.range(5))
    assert table.count() == 5 and len(spark._tellurian_cuts) == 1
    lineage.release(spark)
    with pytest.raises(Exception, match="(?i)not.exist"):
        spark.read.parquet(table.inputFiles()[0])
    assert spark._tellurian_cuts == []
