from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurian.operators import blend
from tellurian.sources import geotiff
from tests.conftest import array_of, grid_of


def surface(rows, cols, seed=1):
    z = np.random.default_rng(seed).normal(100, 30, (rows, cols)).round(3)
    z[3:6, 2:9] = np.nan
    return z


def cells(spark, z):
    return grid_of(spark, [[None if np.isnan(v) else v for v in row] for row in z])


def same(df, z, value="z"):
    np.testing.assert_array_equal(array_of(df, value), z)


def test_round_trip_with_nodata_and_overviews(spark, tmp_path):
    z = surface(150, 210)
    path = f"{tmp_path}/out"
    geotiff.write_geotiff(cells(spark, z), path, sheet=128, tile=32, overviews=2, geo=(1000.0, 2.0, 0.0, 5000.0, 0.0, -2.0), epsg=32631)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["sheet-0-0.tif", "sheet-0-1.tif", "sheet-1-0.tif", "sheet-1-1.tif"]
    back = geotiff.read_geotiff(spark, path)
    assert back.columns == ["r", "c", "z"]
    same(back, z)
    want = blend.pyramid(cells(spark, z), 2)
    for level in (1, 2):
        np.testing.assert_allclose(array_of(geotiff.read_geotiff(spark, path, level), "z"), array_of(want.where(F.col("level") == level), "z"), rtol=1e-12)
    image = geotiff.images(f"{path}/sheet-1-1.tif")[0]
    assert (image.origin, image.epsg, image.nodata, image.geo[0], image.geo[3]) == ((128, 128), 32631, -9999.0, 1000.0 + 128 * 2, 5000.0 - 128 * 2)
    with pytest.raises(Exception, match="overviews"):
        geotiff.read_geotiff(spark, path, 3).count()


def test_window_touches_its_tiles_only(spark, tmp_path):
    z = surface(96, 96)
    path = f"{tmp_path}/w"
    geotiff.write_geotiff(cells(spark, z), path, sheet=96, tile=16)
    name = f"{path}/sheet-0-0.tif"
    image = geotiff.images(name)[0]
    window = "r BETWEEN 20 AND 30 AND c >= 64 AND c < 80"
    # All other tiles become rubbish: only a reader that leaves them alone gets through.
    data = bytearray((tmp_path / "w/sheet-0-0.tif").read_bytes())
    for i, (at, n) in enumerate(zip(image.offsets, image.sizes, strict=True)):
        if i != 1 * 6 + 4:
            data[at : at + n] = bytes(n)
    (tmp_path / "w/sheet-0-0.tif").write_bytes(data)
    got = geotiff.read_geotiff(spark, path).where(window)
    np.testing.assert_array_equal(array_of(got, "z"), z[20:31, 64:80])
    with pytest.raises(Exception, match="broken tile"):
        geotiff.read_geotiff(spark, path).count()
    reader = geotiff.GeoTiffReader({"path": path}, geotiff.read_geotiff(spark, path).schema)
    list(reader.pushFilters([geotiff.GreaterThanOrEqual(("r",), 20), geotiff.LessThanOrEqual(("r",), 40), geotiff.In(("c",), (3, 18)), geotiff.EqualTo(("z",), 1.0)]))
    assert reader.wanted(image) == [6, 7, 12, 13]
    assert geotiff.read_geotiff(spark, path).where("r > 1000").count() == 0


def test_bands_kinds_and_modes(spark, tmp_path):
    d = spark.createDataFrame([(r, c, float(r), float(r * c) if r != c else None) for r in range(20) for c in range(20)], "r long, c int, first double, second double")
    for dtype, nodata in (("u1", 255), ("i2", -1), ("f4", -9999), ("u4", 4_000_000_000)):
        path = f"{tmp_path}/{dtype}"
        small = d.withColumn("second", F.least("second", F.lit(200.0)))
        geotiff.write_geotiff(small, path, sheet=16, tile=16, dtype=dtype, nodata=nodata)
        back = geotiff.read_geotiff(spark, path)
        assert back.columns == ["r", "c", "b1", "b2"]
        assert sorted(map(tuple, back.where("r < 20 AND c < 20").collect())) == sorted(map(tuple, small.collect()))
    with pytest.raises(Exception, match="already"):
        geotiff.write_geotiff(d, path, sheet=16, tile=16)
    geotiff.write_geotiff(d.where("r < 16 AND c < 16").select("r", "c", "first"), path, sheet=16, tile=16, mode="overwrite")
    assert len(list((tmp_path / "u4").glob("*.tif"))) == 1 and geotiff.read_geotiff(spark, path).count() == 256
    with pytest.raises(ValueError):
        geotiff.write_geotiff(d, f"{tmp_path}/x", sheet=100, tile=16)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    bad = cells(spark, surface(40, 40)).withColumn("z", F.when(F.col("r") == 39, F.raise_error(F.lit("stop"))).otherwise(F.col("z")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        geotiff.write_geotiff(bad, f"{tmp_path}/gone", sheet=16, tile=16)
    assert not (tmp_path / "gone").exists()
    good = cells(spark, surface(20, 20))
    geotiff.write_geotiff(good, f"{tmp_path}/kept", sheet=32, tile=16)
    before = (tmp_path / "kept/sheet-0-0.tif").read_bytes()
    with pytest.raises(Exception, match="stop"):
        geotiff.write_geotiff(bad, f"{tmp_path}/kept", sheet=32, tile=16, mode="overwrite")
    assert [p.name for p in (tmp_path / "kept").glob("*") if not p.name.startswith(".")] == ["sheet-0-0.tif"] and (tmp_path / "kept/sheet-0-0.tif").read_bytes() == before


def classic(z, order, compression, predictor, strip_rows, nodata):
    """A classic TIFF in strips, as other writers make them."""
    kind = np.dtype(order + ("f4" if z.dtype.kind == "f" else "i2"))
    body, offsets, sizes = b"", [], []
    for r in range(0, z.shape[0], strip_rows):
        part = z[r : r + strip_rows].astype(kind)
        if predictor == 2:
            raw = np.diff(part.astype(kind.newbyteorder("=")), axis=1, prepend=kind.newbyteorder("=").type(0)).astype(kind).tobytes()
        elif predictor == 3:
            planes = part.astype(kind.newbyteorder(">")).view(np.uint8).reshape(len(part), -1, 4).transpose(0, 2, 1).reshape(len(part), -1)
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        else:
            raw = part.tobytes()
        packed = zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw
        offsets.append(8 + len(body))
        sizes.append(len(packed))
        body += packed
    fields = [(256, 3, [z.shape[1]]), (257, 3, [z.shape[0]]), (258, 3, [kind.itemsize * 8]), (259, 3, [compression]), (262, 3, [1]), (273, 4, offsets), (277, 3, [1]), (278, 3, [strip_rows]), (279, 4, sizes), (317, 3, [predictor]), (339, 3, [3 if kind.kind == "f" else 2]), (42113, 2, nodata.encode() + b"\0")]
    at = 8 + len(body)
    free = at + 2 + 12 * len(fields) + 4
    head, tail = struct.pack(order + "H", len(fields)), b""
    for tag, code, v in fields:
        raw = v if code == 2 else struct.pack(f"{order}{len(v)}{'H' if code == 3 else 'I'}", *v)
        head += struct.pack(order + "HHI", tag, code, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(tail)))
        tail += raw if len(raw) > 4 else b""
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + body + head + bytes(4) + tail


def lzw(data):
    table, out, wide, w = {bytes([k]): k for k in range(256)}, [(256, 9)], 9, b""
    n = 258
    for byte in data:
        x = w + bytes([byte])
        if x in table:
            w = x
            continue
        out.append((table[w], wide))
        table[x] = n
        n += 1
        w = bytes([byte])
        if n == 4094:
            out.append((table[w], wide))
            out.append((256, wide))
            table, wide, w, n = {bytes([k]): k for k in range(256)}, 9, b"", 258
        else:
            wide = max(9, min(12, n.bit_length()))
    if w:
        out.append((table[w], wide))
        n += 1
        wide = max(9, min(12, n.bit_length()))
    out.append((257, wide))
    bits = "".join(format(c, f"0{k}b") for c, k in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_files_of_other_writers(spark, tmp_path, order, compression):
    rng = np.random.default_rng(2)
    for z, predictor in ((rng.integers(-300, 300, (53, 70)).astype(float).astype(np.float32), 1), (np.cumsum(rng.normal(0, 1, (53, 70)), axis=1).astype(np.float32), 3), (rng.integers(-300, 300, (53, 70)).astype(np.int16), 2)):
        (tmp_path / "a.tif").write_bytes(classic(z, order, compression, predictor, 10, "7"))
        want = z.astype(float)
        want[want == 7] = np.nan
        same(geotiff.read_geotiff(spark, f"file://{tmp_path}/a.tif"), want)


def test_malformed_files_are_errors(spark, tmp_path):
    whole = geotiff.encode(np.ones((40, 40, 1)), (0, 0), 16, "f4", -1.0)
    cases = {"empty": b"", "text": b"no picture at all", "cut": whole[: len(whole) - 30], "short": whole[:12]}
    circle = bytearray(whole)
    at = struct.unpack_from("<Q", circle, 8)[0]
    n = struct.unpack_from("<Q", circle, at)[0]
    struct.pack_into("<Q", circle, at + 8 + 20 * n, at)
    cases["circle"] = bytes(circle)
    for name, data in cases.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
        with pytest.raises(Exception, match="TIFF|ends before|holds no|circle"):
            geotiff.read_geotiff(spark, f"{tmp_path}/{name}.tif").count()
    (tmp_path / "folder").mkdir()
    for missing in ("nothing.tif", "folder"):
        with pytest.raises(Exception, match="no file|no GeoTIFF"):
            geotiff.read_geotiff(spark, f"{tmp_path}/{missing}").count()
