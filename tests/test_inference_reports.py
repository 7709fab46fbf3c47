from __future__ import annotations

import json
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurian.operators import inference
from tellurian.sources import reports
from tests.conftest import grid_of


def test_resizes():
    labels = np.array([[1, 2], [3, 4]])
    assert inference.resize_nearest(labels, (4, 4)).tolist() == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    smooth = inference.resize_bilinear(np.array([[0.0, 4.0]]), (1, 4))
    assert smooth.tolist() == [[0.0, 1.0, 3.0, 4.0]]
    assert inference.resize_bilinear(np.ones((2, 2, 3)), (5, 4)).shape == (5, 4, 3)


def test_segmentation_over_tiles(spark):
    z = [[float(c >= 6) for c in range(12)] for _ in range(10)]

    def build():
        return lambda x: [np.stack([0.5 - x[0, 0], x[0, 0] - 0.5])[None] * 20]

    got = inference.segment(grid_of(spark, z), build, 0.5, tile=4, overlap=2, size=(6, 6))
    assert got.count() == 120
    assert {r.label for r in got.where("c < 3").collect()} == {0} and {r.label for r in got.where("c > 8").collect()} == {1}
    with pytest.raises(Exception, match="segmentation model"):
        inference.segment(grid_of(spark, z), lambda: lambda x: [np.zeros((2, 2))], 0.5).count()


def test_model_kind(spark):
    d = spark.createDataFrame([("a_UNet.onnx", 2, 3), ("yolo8.onnx", 1, 4), ("m.onnx", 1, 4), ("m.onnx", 4, 2)], "n string, k int, d int")
    assert [r[0] for r in d.select(inference.model_kind(F.col("n"), F.col("k"), F.col("d"))).collect()] == ["segmentation", "detection", "segmentation", "detection"]


def test_documents(spark):
    assert reports.anomaly_template(spark).count() == 0 and len(reports.anomaly_template(spark).columns) == 10
    text = reports.statistics_report(grid_of(spark, [[1.0, 2.0, None]]), "Site", {"radius": 3})
    assert "| valid | 2 |" in text and "- radius: 3" in text
    page = reports.viewer_page("<x>", 'a"b.png', float("inf"))
    assert "<x>" not in page and "Infinity" not in page
    assert ElementTree.fromstring(reports.field_project("a&b", ["l<1"], {"type": ["bank"]}).encode()).get("name") == "a&b"
    assert reports.pyramid_complaints({"tiled": True, "block": 256, "rows": 2000, "cols": 10}) == ["no overviews"]
    assert json.loads(reports.point_pipeline({"slope": 0.15}, 1.0, "a", "b"))[1]["slope"] == 0.15
