from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

import __spark_entry__
from tellurian.operators import inference
from tellurian.plans import catalog
from tellurian.sources import surfaces
from tests.conftest import SF, assert_alike, duck_rows, rows


@pytest.fixture(scope="module")
def compared(spark, duck, request):
    """Rows of both engines for each query that is asked for; several queries run at a time."""
    names = sorted({i.callspec.params["name"] for i in request.session.items if "name" in getattr(getattr(i, "callspec", None), "params", {}) and i.module.__name__ == __name__})
    both = lambda n: (rows(catalog.queries()[n](spark, SF)), duck_rows(duck.cursor(), catalog.oracle_sql()[n]))
    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(both, n) for n in names}
        pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_its_sql(compared, name):
    assert_alike(*compared[name].result())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert SF.startswith("/root/testdata")


def test_detection_query_equals_brute_force(spark):
    """All windows in plain loops, then the sequential rule over their union."""
    pdf = surfaces.dem_dense(spark, SF).toPandas()
    z = pdf.pivot(index="r", columns="c", values="z").to_numpy(float)
    low, high = np.quantile(z, 0.02), np.quantile(z, 0.98)
    model, boxes, (rows, cols) = catalog._bright_blocks(), [], z.shape
    for r0 in range(0, rows, 24):
        for c0 in range(0, cols, 24):
            block = z[r0 : r0 + 32, c0 : c0 + 32]
            found = [b for b in model(inference.tile_input(block, (32, 32), low, high))[0][0].tolist() if b[4] >= 0.52]
            for n, (x1, y1, x2, y2, sure, kind) in enumerate(found):
                h, w = block.shape
                place = lambda v, off, size: round(min(max(v * size / 32 + off, off), off + size), 2)
                boxes.append(((r0 * cols + c0) * (1 << 20) + n, place(x1, c0, w), place(y1, r0, h), place(x2, c0, w), place(y2, r0, h), round(sure, 4), int(kind)))

    def iou(a, b):
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        area = lambda x: (x[3] - x[1]) * (x[4] - x[2])
        return 0 if w < 0 or h < 0 else w * h / (area(a) + area(b) - w * h)

    want: list = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(k, b) < 0.3 for k in want if k[6] == b[6]):
            want.append(b)
    got = catalog.queries()["detect_features"](spark, SF).collect()
    assert {r.id for r in got} == {b[0] for b in want} and len(got) == len(want) > 5
    assert {r.class_name for r in got} == {"barrow", "bank"}
