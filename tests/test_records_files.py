from __future__ import annotations

import time
import json
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellurian.functions import records, scale, text
from tellurian.sources import files
from tellurian.streaming import tiles
from tests.conftest import grid_of


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scale(spark):
    assert one(spark, scale.pixels(F.lit(20.0), "metres", F.lit(0.25))) == 80
    assert one(spark, scale.pixels(F.lit(0.2), "pixels", F.lit(1.0))) == 1
    assert scale.preset("coastal", 100.0)["ld_max"] == 2
    for call in (lambda: scale.preset("lunar"), lambda: scale.preset("coastal", 0), lambda: scale.pixels(F.lit(1), "miles", F.lit(1))):
        with pytest.raises(ValueError):
            call()


def test_text(spark):
    assert one(spark, text.redact(F.lit("API_KEY: abc, x token=q;"))) == "API_KEY:<REDACTED>, x token=<REDACTED>;"
    assert one(spark, text.safe_component(F.lit("../é b?"))) == "é_b"
    assert one(spark, text.project_name(F.lit("../../a b"))) == "a_b"
    assert one(spark, text.project_name(F.lit(None).cast("string"))) == "untitled"
    assert one(spark, text.escape_html(F.lit("<a&'\">"))) == "&lt;a&amp;&#39;&quot;&gt;"
    assert one(spark, text.encode_url(F.lit("a b+c"))) == "a%20b%2Bc"
    with pytest.raises(ValueError):
        text.output_name("a/{dem}", F.lit("x"), F.lit("y"), F.lit("z"), F.lit("d"))
    with pytest.raises(ValueError):
        text.output_name("{who}", F.lit("x"), F.lit("y"), F.lit("z"), F.lit("d"))


def test_recipes(spark):
    good = records.recipe_json({"svf": {"search_radius": 10, "num_directions": 16, "enabled": True}}, "a")
    assert one(spark, records.recipe_errors(F.lit(good))) == []
    assert len(one(spark, records.recipe_errors(F.lit('{"recipe_version": "1", "landscape_type": "moon"}')))) == 3
    assert one(spark, records.recipe_errors(F.lit("[]"))) == ["recipe: object expected"]
    assert records.recipe_presets(json.loads(good)) == {"svf": {"search_radius": 10, "num_directions": 16}}


def test_las_round_trip(spark, tmp_path):
    x, y, z = np.array([1.0, 2.5]), np.array([3.0, 4.0]), np.array([5.125, -6.0])
    (tmp_path / "a.las").write_bytes(files.las_bytes(x, y, z, np.array([2, 5])))
    got = files.read_las(spark, str(tmp_path / "a.las")).orderBy("x").collect()
    assert [(r.x, r.y, r.z, r.classification) for r in got] == [(1.0, 3.0, 5.125, 2), (2.5, 4.0, -6.0, 5)]


def test_ascii_grid_and_cells(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nnodata_value -9999\n1 2\n3 -9999\n")
    got = {(r.r, r.c): r.z for r in files.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): None}
    files.write_cells(grid_of(spark, [[1.0, None]]), str(tmp_path / "cells"), nodata=-9999.0)
    assert {(r.c, r.z) for r in files.read_cells(spark, str(tmp_path / "cells"), -9999.0).collect()} == {(0, 1.0), (1, None)}


def test_pictures_and_bundle(spark):
    sheet = files.contact_sheet([("a", np.full((4, 4), 9, np.uint8)), ("b", np.zeros((4, 4), np.uint8))], columns=2)
    assert files.png_bytes(sheet)[:8] == b"\x89PNG\r\n\x1a\n" and sheet[9, 9, 0] == 9
    names = zipfile.ZipFile(BytesIO(files.support_bundle(spark, "token=abc", "1.0"))).read("diagnostics.txt")
    assert names == b"token=<REDACTED>\n"
    assert json.loads(files.viewer_config("t", float("nan"), 3, (1.0, None)))["zoom"] == 12.0


def test_streaming_ingest(spark, tmp_path):
    pts = spark.createDataFrame([(0.2, 0.2, 5.0), (0.4, 0.1, 3.0), (9.0, 9.0, 1.0)], "x double, y double, z double")
    pts.write.parquet(str(tmp_path / "in"))
    q = tiles.ingest(spark, str(tmp_path / "in"), "x double, y double, z double", str(tmp_path / "out"), str(tmp_path / "cp"), 1.0)
    q.awaitTermination(120)
    assert {(r.r, r.c, r.z) for r in tiles.current(spark, str(tmp_path / "out")).collect()} == {(0, 0, 3.0), (9, 9, 1.0)}


def test_recipe_files(spark, tmp_path):
    good = records.recipe_json({"svf": {"enabled": True, "radius": 10}}, "fort", landscape="coastal")
    for name, text in (("good", good), ("cut", good[:-5]), ("list", "[1, 2]"), ("old", good.replace("1.0.0", "one"))):
        (tmp_path / f"{name}.json").write_text(text)
    found = {r.path.rsplit("/", 1)[1]: r for r in files.read_recipes(spark, str(tmp_path)).collect()}
    assert (found["good.json"].name, found["good.json"].landscape, list(found["good.json"].errors)) == ("fort", "coastal", [])
    assert list(found["cut.json"].errors) == ["recipe: not JSON"] and found["cut.json"].name is None
    assert list(found["list.json"].errors) == ["recipe: object expected"] and len(found["old.json"].errors) == 1
    assert files.read_recipe(spark, f"{tmp_path}/good.json") == json.loads(good)
    for name, error in (("none", FileNotFoundError), ("cut", ValueError), ("old", ValueError)):
        with pytest.raises(error):
            files.read_recipe(spark, f"{tmp_path}/{name}.json")


def test_recipe_fields_are_looked_up_only_where_they_are_named(spark):
    docs = ['{"recipe_version": "1.0.0", "algorithms": {"svf": {"num_directions": "many", "enabled": 3}, "slope": 4}}', r'{"recipe_version": "1.0.0", "algorithms": {"\u0073vf": {"num_directions": 1.5}}}', "[]", None,
            '{"recipe_version": "1.0.0", "algorithms": {}, "note": "svf num_directions enabled"}', '{"recipe_version": "1.0.0", "algorithms": {"svf": {"search_radius": 1e1}, "svf": {"enabled": null}}}']
    d = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    got = {r.id: r.errors for r in d.select("id", records.recipe_errors(F.col("doc")).alias("errors")).collect()}
    assert got == {
        0: ["svf.enabled: true or false expected", "svf.num_directions: whole number expected", "slope: object expected"], 1: ["svf.num_directions: whole number expected"],
        2: ["recipe: object expected"], 3: ["recipe: object expected"], 4: [], 5: [],
    }
    many = spark.range(100_000, numPartitions=1).select(records.recipe_errors(F.concat(F.lit(docs[0][:-1] + ', "n": '), "id", F.lit("}"))).alias("errors"))
    began = time.time()
    assert many.where(F.size("errors") == 3).count() == 100_000 and time.time() - began < 12
