from __future__ import annotations

import struct

import numpy as np
import pytest

from tellurian.sources import files, las


def survey(tmp_path, n=1000, parts=4):
    """Files side by side along x, a hundred metres each."""
    rng = np.random.default_rng(3)
    all_points = []
    for k in range(parts):
        x, y, z = rng.uniform(100 * k, 100 * k + 100, n).round(3), rng.uniform(0, 50, n).round(3), rng.uniform(0, 9, n).round(3)
        (tmp_path / f"{k}.las").write_bytes(files.las_bytes(x, y, z, np.arange(n) % 7))
        all_points += list(zip(x, y, z, (np.arange(n) % 7).tolist(), strict=True))
    return sorted(all_points)


def points_of(df):
    return sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.classification) for r in df.collect())


def test_many_partitions_equal_one(spark, tmp_path):
    want = survey(tmp_path)
    whole = las.read_las(spark, str(tmp_path))
    small = las.read_las(spark, f"file://{tmp_path}", 20 * 37)
    assert small.rdd.getNumPartitions() == 4 * -(-1000 // 37) and whole.rdd.getNumPartitions() == 4
    assert points_of(whole) == points_of(small) == want
    assert las.read_las(spark, f"{tmp_path}/2.las").count() == 1000


def test_files_outside_the_filter_are_not_read(spark, tmp_path):
    want = survey(tmp_path)
    # A body of rubbish that only a reader of the file would meet: its points would all lie inside the window.
    data = bytearray((tmp_path / "3.las").read_bytes())
    data[227:] = struct.pack("<3i8x", 150_000, 10_000, 1_000) * 1000
    (tmp_path / "3.las").write_bytes(data)
    got = las.read_las(spark, str(tmp_path)).where("x >= 120 AND x < 180 AND y > 5 AND classification = 3")
    assert points_of(got) == [p for p in want if 120 <= p[0] < 180 and p[1] > 5 and p[3] == 3]
    reader = las.LasReader({"path": str(tmp_path)}, got.schema)
    rest = list(reader.pushFilters([las.GreaterThan(("x",), 120.0), las.LessThan(("x",), 180.0), las.EqualTo(("classification",), 3)]))
    assert len(rest) == 1 and [p.value[0].path[-5:] for p in reader.partitions()] == ["1.las"]
    assert las.read_las(spark, str(tmp_path)).where("z > 1000").count() == 0


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of LAS 1.4 with 120 million records; only its last records are read."""
    n, path = 120_000_000, tmp_path / "big.las"
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 6
    struct.pack_into("<HI", head, 94, 375, 375)
    struct.pack_into("<HI", head, 105, 30, 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 0, 0, 0)
    struct.pack_into("<Q", head, 247, n)
    with path.open("wb") as f:
        f.write(head)
        f.seek(375 + (n - 1) * 30)
        f.write(struct.pack("<3i4xB13x", 700, 800, 900, 9))
    assert path.stat().st_size > 3 << 30
    reader = las.LasReader({"path": str(path)}, las.read_las(spark, str(path)).schema)
    parts = reader.partitions()
    assert sum(p.value[2] for p in parts) == n and all(p.value[2] * 30 <= las.READ_BYTES for p in parts)
    *_, last = reader.read(parts[-1])
    assert [last.column(k)[-1].as_py() for k in ("x", "y", "z", "classification")] == [7.0, 8.0, 9.0, 9]


def test_files_that_are_no_las(spark, tmp_path):
    good = files.las_bytes(np.arange(9.0), np.arange(9.0), np.arange(9.0), np.zeros(9, int))
    for name, data, why in (("text", b"no points", "not a LAS"), ("cut", good[:-5], "ends before")):
        (tmp_path / f"{name}.las").write_bytes(data)
        with pytest.raises(Exception, match=why):
            las.read_las(spark, f"{tmp_path}/{name}.las").count()
    with pytest.raises(Exception, match="no file"):
        las.read_las(spark, f"{tmp_path}/none.las").count()
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/a.las").write_bytes(files.las_bytes(*[np.zeros(0)] * 4))
    assert las.read_las(spark, f"{tmp_path}/empty").count() == 0


def test_any_thread_may_read(spark, tmp_path):
    from threading import Thread

    (tmp_path / "a.las").write_bytes(files.las_bytes(np.arange(9.0), np.arange(9.0), np.arange(9.0), np.zeros(9, int)))
    found = []
    threads = [Thread(target=lambda: found.append(las.read_las(spark, str(tmp_path)).count())) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found == [9, 9, 9]
