from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from tellurian.operators import stencil
from tellurian.streaming import tiles
from tests.conftest import array_of

SCHEMA = "x double, y double, z double"


def batches(seed=3, n=5):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        x, y = rng.uniform(-20, 40, 150) + 8 * k, rng.uniform(0, 50, 150)
        out.append([(float(a), float(b), float(c)) for a, b, c in zip(x, y, rng.normal(10, 3, 150), strict=True)])
    out[1] += [(None, 1.0, 1.0), (1.0, 1.0, None), (1.0, 1.0, float("nan"))]
    return out


def values(df, name):
    return {(r.r, r.c): r[name] for r in df.collect()}


def written(target):
    return {str(p.relative_to(target)) for p in Path(target).glob("cells/v=*/tile_r=*/tile_c=*")}, {str(p.relative_to(target)) for p in Path(target).glob("slopes/v=*/tile_r=*/tile_c=*")}


def test_after_any_batches_the_state_equals_the_batch_operators(spark, tmp_path):
    target, seen = str(tmp_path / "state"), []
    for k, rows in enumerate(batches()):
        tiles.refresh(spark.createDataFrame(rows, SCHEMA), k, target, 1.0, 8)
        seen += rows
        whole = tiles.lowest(spark.createDataFrame(seen, SCHEMA), 1.0)
        if k in (0, 2, 4):
            assert values(tiles.current(spark, target), "z") == values(whole, "z")
            got, want = values(tiles.current_slopes(spark, target), "slope"), values(tiles.slopes(whole, 1.0), "slope")
            assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-12) for c in want)
    before = values(tiles.current_slopes(spark, target), "slope")
    # A replay of the last batch, and one that brings nothing lower.
    tiles.refresh(spark.createDataFrame(batches()[4], SCHEMA), 4, target, 1.0, 8)
    tiles.refresh(spark.createDataFrame([(x, y, None if z is None else z + 50) for x, y, z in batches()[4]], SCHEMA), 5, target, 1.0, 8)
    assert values(tiles.current_slopes(spark, target), "slope") == before and values(tiles.current(spark, target), "z") == values(whole, "z")
    assert not any(p.split("/")[1] == "v=5" for some in written(target) for p in some)


def test_tiles_beside_the_change_are_not_written_again(spark, tmp_path):
    target = str(tmp_path / "state")
    grid = [(c + 0.5, r + 0.5, float((r * 7 + c * 3) % 11)) for r in range(40) for c in range(40)]
    tiles.refresh(spark.createDataFrame(grid, SCHEMA), 0, target, 1.0, 8)
    assert [len(w) for w in written(target)] == [25, 25]
    tiles.refresh(spark.createDataFrame([(20.5, 12.5, -5.0)], SCHEMA), 1, target, 1.0, 8)
    cells, steep = ({p for p in w if "v=1/" in p} for w in written(target))
    assert cells == {"cells/v=1/tile_r=1/tile_c=2"} and steep == {f"slopes/v=1/tile_r={r}/tile_c={c}" for r in (0, 1, 2) for c in (1, 2, 3)}
    # On a whole grid the slopes are those of the batch operator, edges included.
    want = array_of(stencil.slope(tiles.current(spark, target), 1.0), "slope")
    np.testing.assert_allclose(array_of(tiles.current_slopes(spark, target), "slope"), want, atol=1e-12)


def test_stream_of_files(spark, tmp_path):
    seen = []
    for k, rows in enumerate(batches(9, 3)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen += rows
        if k == 1:
            continue
        query = tiles.ingest(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "state"), str(tmp_path / "checkpoint"), 1.0, 16, files=1)
        assert query.awaitTermination(120)
    assert values(tiles.current(spark, str(tmp_path / "state")), "z") == values(tiles.lowest(spark.createDataFrame(seen, SCHEMA), 1.0), "z")
    assert tiles.current(spark, str(tmp_path / "nothing")).count() == 0
