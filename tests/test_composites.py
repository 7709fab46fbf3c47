from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurian.operators import blend, change
from tests.conftest import array_of, grid_of


@pytest.mark.parametrize("a,b,mode,opacity,want", [
    (255, 128, "multiply", 1.0, 128), (128, 64, "soft_light", 1.0, 95.6), (64, 128, "overlay", 1.0, 64.25), (192, 128, "overlay", 1.0, 192), (255, 0, "multiply", 0.5, 127.5), (None, 3.0, "screen", 1.0, None),
])
def test_blends(spark, a, b, mode, opacity, want):
    got = spark.createDataFrame([(a, b)], "a double, b double") if a is None else spark.createDataFrame([(float(a), float(b))], "a double, b double")
    value = got.select(blend.blend(F.col("a"), F.col("b"), mode, opacity)).first()[0]
    assert value is None if want is None else value == pytest.approx(want, abs=1)


def test_constant_composites(spark):
    flat = grid_of(spark, [[10.0] * 10] * 10)
    assert np.allclose(array_of(blend.vat(flat, 1.0, 2, 2), "vat"), 71.71875, atol=1)
    assert np.allclose(array_of(blend.red_relief(flat, 1.0, 3), "red_relief"), 0)


def test_e4mstp_constants(spark):
    base = {"o_pos": 0.8, "o_neg": 0.7, "ld": 0.5, "s": 0.1, "mstp_r": 0.5, "mstp_g": 0.5, "mstp_b": 0.5, "svf_s": 1.0, "svf_l": 1.0}
    names = list(base)
    rows = [(0, 0, *[None if n == "o_pos" else base[n] for n in names]), (0, 1, *[None if n.startswith("svf") else base[n] for n in names])]
    d = spark.createDataFrame(rows, "r long, c int, " + ", ".join(f"{n} double" for n in names))
    got = {r.c: (r.red, r.green, r.blue) for r in blend.e4mstp(d).collect()}
    assert got == {0: (25, 0, 0), 1: (25, 64, 64)}


def test_pca_of_constant_layers(spark):
    d = grid_of(spark, [[1.0] * 4] * 4).select("r", "c", *[F.lit(2.0).alias(n) for n in ("svf", "opn", "slope", "ld")])
    assert blend.pca(d).agg(F.max("pc1"), F.max("pc3")).first() == (0.0, 0.0)


def test_pca_range(spark):
    rng = np.random.default_rng(42)
    rows = [(i // 20, i % 20, *map(float, rng.uniform(0, 1, 4))) for i in range(400)]
    got = blend.pca(spark.createDataFrame(rows, "r long, c int, svf double, opn double, slope double, ld double"))
    low, high = got.agg(F.min("pc1"), F.max("pc1")).first()
    assert low == 0 and high == 255


def test_difference(spark):
    old = grid_of(spark, [[1.0, 1.0, 1.0, None]])
    new = grid_of(spark, [[3.0, -1.0, 1.1, 1.0]])
    limit = change.detection_limit()
    d = change.difference(old, new, limit)
    assert [r.mask for r in d.orderBy("c").collect()] == [2, 1, 0, 255]
    r = change.difference_report(d, 2.0, limit).first()
    assert (r.total_cells, r.significant, r.cut_volume, r.fill_volume, r.net_volume) == (3, 2, 4.0, 4.0, 0.0)


def test_fusion_needs_its_bands(spark):
    assert change.missing_bands("bare_earth", ["B4", "B11"]) == ["B12"]
    with pytest.raises(ValueError):
        change.fuse(grid_of(spark, [[1.0]]), "z", ("z", "z", "z"), "burn", 0.5)


def test_resampling(spark):
    cells = grid_of(spark, [[1.0, 2.0], [3.0, None]])
    assert change.resample_aggregate(cells, 2, "average").first()["z"] == 2.0
    assert array_of(change.resample_nearest(cells, 2.0, 4, 4), "z")[0, 3] == 2.0
    assert change.resample_bilinear(cells, 2.0, 4, 4, 1, 1).where("z IS NULL").count() == 9
    with pytest.raises(ValueError):
        change.resample_aggregate(cells, 2, "guess")


def test_overview_levels():
    assert [blend.overview_levels(n, 10) for n in (512, 513, 1024, 4096)] == [0, 1, 2, 4]
