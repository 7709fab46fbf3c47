"""Readers and writers: cell tables, ASCII grids, LAS points, PNG previews, note files.

Big tables go through Spark's own Parquet reader and writer; small foreign files
come in as ``binaryFile`` rows and are unpacked on the executors.
"""

from __future__ import annotations

import io
import json
import logging
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.functions.records import recipe_errors
from tellurian.functions.text import redact
from tellurian.operators.grid import from_nodata, to_nodata
from tellurian.operators.lineage import cut
from tellurian.operators.points import ground_surface
from tellurian.sources.las import read_las

CELLS = "r long, c int, z double"


def read_cells(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """A Parquet cell table, its tagged nodata as NULL."""
    return from_nodata(spark.read.parquet(path).selectExpr("CAST(r AS long) r", "CAST(c AS int) c", "CAST(z AS double) z"), nodata)


def write_cells(cells: DataFrame, path: str, tile: int = 1024, nodata: float | None = None, mode: str = "errorifexists") -> None:
    """Parquet by tile row, so that a reader of some rows prunes the rest."""
    out = cells if nodata is None else to_nodata(cells, nodata)
    out.withColumn("tile_r", F.floor(F.col("r") / tile)).repartition("tile_r").sortWithinPartitions("r", "c").write.mode(mode).partitionBy("tile_r").parquet(path)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Esri ASCII grids as cells (path, r, c, z); rows are unpacked one at a time."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                lines = io.StringIO(content.decode())
                head: dict[str, float] = {}
                for _ in range(6):
                    key, value = lines.readline().split()
                    head[key.lower()] = float(value)
                for r in range(int(head["nrows"])):
                    z = np.array(lines.readline().split(), float)
                    z[np.abs(z - head["nodata_value"]) <= 1e-5] = np.nan
                    yield pd.DataFrame({"path": name, "r": r, "c": np.arange(len(z), dtype=np.int32), "z": z})

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return from_nodata(raw.mapInPandas(unpack, f"path string, {CELLS}"), None)


def las_surface(spark: SparkSession, path: str, cellsize: float, ground: str = "pmf_archaeology_standard", radius: float | None = None) -> DataFrame:
    """(r, c, z) from LAS files: read, ground filter, gridding; an error for fewer than ten points."""
    p = cut(read_las(spark, path).select(F.monotonically_increasing_id().alias("id"), "x", "y", "z", "classification"))
    return ground_surface(p, cellsize, ground, radius)


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> bytes:
    """A small LAS 1.2 file of format 0."""
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    head[104] = 0
    struct.pack_into("<HI", head, 105, 20, len(x))
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0.0, 0.0, 0.0)
    rows = np.zeros((len(x), 20), np.uint8)
    rows[:, :12] = np.round(np.stack([x, y, z], axis=1) / scale).astype("<i4").view(np.uint8).reshape(len(x), 12)
    rows[:, 15] = classification
    if len(x):
        xyz = rows[:, :12].copy().view("<i4") * scale
        struct.pack_into("<6d", head, 179, *[float(f(xyz[:, k])) for k in range(3) for f in (np.max, np.min)])
    return bytes(head) + rows.tobytes()


def preview(cells: DataFrame, value: str, most: int = 1_000_000) -> np.ndarray:
    """A small layer as an array on the driver; larger ones must be downsampled first."""
    n = cells.count()
    if n > most:
        raise ValueError(f"{n} cells are too many for a preview; downsample first")
    pdf = cells.select("r", "c", value).toPandas()
    r, c = pdf["r"] - pdf["r"].min(), pdf["c"] - pdf["c"].min()
    out = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
    out[r, c] = pdf[value].astype(float)
    return out


def png_bytes(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    high, wide = rgb.shape[:2]
    part = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    lines = b"".join(b"\0" + row.tobytes() for row in rgb.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def contact_sheet(panels: list[tuple[str, np.ndarray]], columns: int = 3, gap: int = 8) -> np.ndarray:
    """Byte panels of equal size side by side on a dark ground, in the order given."""
    from tellurian.functions.records import sheet_positions

    side = max(max(p.shape[:2]) for _, p in panels)
    places = sheet_positions([n for n, _ in panels], columns, side, gap)
    rows = -(-len(panels) // columns)
    out = np.full((gap + rows * (side + gap), gap + columns * (side + gap), 3), 24, np.uint8)
    for (_, x, y), (_, p) in zip(places, panels, strict=True):
        out[y : y + p.shape[0], x : x + p.shape[1]] = p[..., None] if p.ndim == 2 else p
    return out


def write_notes(features: DataFrame, path: str) -> None:
    """Notes as JSON lines (.json, .geojson) or CSV (.csv), by the suffix."""
    if path.endswith((".json", ".geojson")):
        features.select("feature").write.mode("overwrite").text(path)
    elif path.endswith(".csv"):
        features.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError("Notes are written as .json, .geojson or .csv")


def support_bundle(spark: SparkSession, diagnostics: str, version: str, preflight: str = "") -> bytes:
    """A ZIP of redacted texts and a manifest."""
    clean = lambda t: spark.range(1).select(redact(F.lit(t))).first()[0].rstrip() + "\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("diagnostics.txt", clean(diagnostics))
        z.writestr("manifest.json", json.dumps({"format": "support-v1", "version": version}, indent=2) + "\n")
        if preflight:
            z.writestr("preflight.txt", clean(preflight))
    return out.getvalue()


def sidecar_path(path: str) -> str:
    """Where the provenance record of an output stands: beside it."""
    return path.rstrip("/") + ".provenance.json"


def write_sidecar(record: DataFrame, output: str) -> str | None:
    """Writes a one-row provenance record beside an output; None where that fails, which never harms the output."""
    path = sidecar_path(output)
    try:
        record.select("record").coalesce(1).write.mode("overwrite").text(path)
    except Exception as error:  # the result that the record describes stands whatever becomes of the record
        logging.getLogger(__name__).warning("No provenance beside %s: %s", output, error)
        return None
    return path


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, landscape, recipe, errors): the recipe files at a path or in a folder, with what is wrong with each.

    ``errors`` is empty for a recipe that can be run; a file that is not JSON has
    one error and nothing else.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("recipe"))
    broken = F.try_parse_json("recipe").isNull()
    named = lambda field: F.when(~broken, F.get_json_object("recipe", f"$.{field}"))
    errors = F.when(broken, F.array(F.lit("recipe: not JSON"))).otherwise(recipe_errors(F.col("recipe")))
    return whole.select("path", named("name").alias("name"), named("landscape_type").alias("landscape"), "recipe", errors.alias("errors"))


def read_recipe(spark: SparkSession, path: str) -> dict:
    """The recipe in one file; an error that lists what is wrong with it, or if there is none."""
    try:
        found = read_recipes(spark, path).limit(2).collect()
    except AnalysisException as error:
        raise FileNotFoundError(f"No recipe at {path}") from error
    if len(found) != 1:
        raise ValueError(f"{path} is not one recipe file")
    if found[0].errors:
        raise ValueError("; ".join(found[0].errors))
    return json.loads(found[0].recipe)


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The record at this path or beside this output; an error if there is none or it is none of ours."""
    found = path if path.endswith(".provenance.json") else sidecar_path(path)
    try:
        lines = [r.value for r in spark.read.text(found).limit(2).collect()]
    except AnalysisException as error:
        raise FileNotFoundError(f"No provenance at {found}") from error
    try:
        record = json.loads("\n".join(lines))
    except ValueError as error:
        raise ValueError(f"{found} is not JSON") from error
    if not isinstance(record, dict) or not {"algorithm", "parameters"} <= set(record):
        raise ValueError(f"{found} is no provenance record")
    return record


def field_package(cells: DataFrame, anomalies: DataFrame, folder: str, name: str) -> dict[str, str]:
    """Writes a survey package: cells, anomaly records and the project text; existing ones are never overwritten.

    ``anomalies`` has x, y and the fields of the anomaly template; a record without
    a required field is an error, and its point becomes WKT.
    """
    from tellurian.functions.text import project_name
    from tellurian.sources.reports import ANOMALY_FIELDS, field_project

    spark = cells.sparkSession
    safe = spark.range(1).select(project_name(F.lit(name))).first()[0]
    paths = {k: f"{folder.rstrip('/')}/{safe}-{k}" for k in ("relief", "survey", "project")}
    given = [F.col(n).cast(t).alias(n) if n in anomalies.columns else F.lit(None).cast(t).alias(n) for n, t, _ in ANOMALY_FIELDS]
    lacking = [n for n, _, must in ANOMALY_FIELDS if must and (n not in anomalies.columns or not anomalies.where(F.col(n).isNull()).isEmpty())]
    if lacking:
        raise ValueError(f"Anomaly records need {', '.join(lacking)}")
    anomalies.select(*given, F.format_string("POINT (%.3f %.3f)", F.col("x").cast("double"), F.col("y").cast("double")).alias("wkt")).write.mode("error").parquet(paths["survey"])
    write_cells(cells, paths["relief"])
    text = field_project(safe, ["relief", "survey"], {"confidence": ["low", "medium", "high"]})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(paths["project"])
    return paths


def viewer_config(title: str, zoom: float, opacity: float, centre: tuple[float, float]) -> str:
    """Web viewer settings as JSON, numbers finite and in range."""
    finite = lambda v, d: float(v) if v is not None and np.isfinite(v) else d
    return json.dumps({"title": title, "zoom": finite(zoom, 12.0), "opacity": min(max(finite(opacity, 1.0), 0.0), 1.0), "centre": [finite(x, 0.0) for x in centre]})


