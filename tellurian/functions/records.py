"""Recipes, provenance, preflight, notes and short lists, as columns and small tables."""

from __future__ import annotations

import importlib
import json
import math
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parameters of recipe algorithms and their JSON types.
RECIPE_PARAMETERS = {
    "svf": {"search_radius": "number", "num_directions": "int", "noise_level": "int"},
    "openness": {"search_radius": "number", "num_directions": "int"},
    "slrm": {"trend_radius": "number"},
    "local_dominance": {"min_radius": "number", "max_radius": "number", "observer_height": "number"},
    "mstp": {"local_radius": "int", "meso_radius": "int", "broad_radius": "int"},
    "asvf": {"azimuth": "number", "anisotropy": "number"},
    "slope": {}, "hillshade": {}, "vat": {}, "red_relief": {}, "pca": {}, "e4mstp": {},
}

#: Landscape types a recipe may name.
LANDSCAPES = ("flat_agricultural", "forested", "upland_steep", "coastal", "custom")


def recipe_errors(doc: Column) -> Column:
    """Array of complaints about a recipe's JSON text; empty if it is valid.

    Each look-up parses the text anew, so that a field is looked up once, and only
    where the text has its name; names with escapes may be written otherwise.
    The text itself is made once, however it is made.
    """
    return F.get(F.transform(F.array(doc), _recipe_errors), F.lit(0))


def _recipe_errors(doc: Column) -> Column:
    field = lambda path: F.get_json_object(doc, path)
    version, algorithms = field("$.recipe_version"), field("$.algorithms")
    object_like = lambda c: F.ltrim(c).startswith("{")
    errors = [
        F.when(version.isNull(), "recipe_version: not given"),
        F.when(algorithms.isNull(), "algorithms: not given"),
        F.when(~version.rlike(r"^\d+\.\d+\.\d+$"), F.concat(F.lit("recipe_version: three numbers expected, found "), version)),
        F.when(algorithms.isNotNull() & ~object_like(algorithms), "algorithms: object expected"),
        F.when((field("$.landscape_type") != "") & ~field("$.landscape_type").isin(*LANDSCAPES), F.concat(F.lit("landscape_type: unknown "), field("$.landscape_type"))),
    ]
    # What is not given compares as null, which is no complaint.
    named = lambda *names: doc.contains("\\") | reduce(and_, [doc.contains(n) for n in names])
    for name, parameters in RECIPE_PARAMETERS.items():
        checks = [(named(name), ~object_like(field(f"$.algorithms.{name}")), f"{name}: object expected")]
        checks.append((named(name, "enabled"), ~field(f"$.algorithms.{name}.enabled").isin("true", "false"), f"{name}.enabled: true or false expected"))
        for parameter, kind in parameters.items():
            form = r"^-?\d+$|^true$|^false$" if kind == "int" else r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$|^true$|^false$"
            checks.append((named(name, parameter), ~field(f"$.algorithms.{name}.{parameter}").rlike(form), f"{name}.{parameter}: {'whole number' if kind == 'int' else 'number'} expected"))
        errors += [F.when(there, F.when(wrong, text)) for there, wrong, text in checks]
    whole = F.array_compact(F.array(*errors))
    return F.when(object_like(F.coalesce(doc, F.lit(""))), whole).otherwise(F.array(F.lit("recipe: object expected")))


def recipe_presets(doc: dict) -> dict:
    """Parameters of each algorithm, without switches and private fields."""
    kept = {a: {k: v for k, v in p.items() if k != "enabled" and not k.startswith("_")} for a, p in doc.get("algorithms", {}).items() if a != "batch_preset"}
    return {a: p for a, p in kept.items() if p}


def recipe_json(algorithms: dict, name: str, version: str = "1.0.0", landscape: str = "custom") -> str:
    """A recipe as JSON text."""
    if not re.fullmatch(r"\d+\.\d+\.\d+", version):
        raise ValueError("A recipe's version has three numbers")
    return json.dumps({"recipe_version": version, "name": name, "landscape_type": landscape, "algorithms": algorithms}, ensure_ascii=False, indent=2)


def provenance(cells: DataFrame, crs: str, cellsize: float, algorithm: str, parameters: dict) -> DataFrame:
    """One row (record STRING): grid, statistics and parameters as JSON."""
    stats = cells.agg((F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("cols"), F.round(F.min("z"), 6).alias("min"), F.round(F.max("z"), 6).alias("max"), F.count("z").alias("valid"))
    grid = F.struct("rows", "cols", "min", "max", "valid", F.lit(crs).alias("crs"), F.lit(cellsize).alias("cellsize"))
    pairs = F.create_map(*[F.lit(str(x)) for kv in sorted(parameters.items()) for x in kv]) if parameters else F.create_map().cast("map<string,string>")
    return stats.select(F.to_json(F.struct(F.lit(algorithm).alias("algorithm"), grid.alias("source"), pairs.alias("parameters"))).alias("record"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(field, recorded, found, same): two (field, value) tables compared null-safely."""
    a, b = recorded.select("field", F.col("value").alias("recorded")), found.select("field", F.col("value").alias("found"))
    return a.join(b, "field", "full").select("field", "recorded", "found", F.col("recorded").eqNullSafe(F.col("found")).alias("same"))


def checksum(content: Column, limit: int = 64 << 20) -> Column:
    """SHA-256 of the first 64 MiB and the size, as ``hex:size``."""
    return F.concat(F.sha2(F.substring(content, 1, limit), 256), F.lit(":"), F.octet_length(content).cast("string"))


def preflight(cells: DataFrame, cellsize: float) -> DataFrame:
    """One row: size, statistics, share of nodata, memory, workload and the advised preset."""
    d = cells.agg(
        (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).cast("long").alias("cols"), F.min("z").alias("min"), F.max("z").alias("max"),
        F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.count("z").alias("valid"), F.count(F.lit(1)).alias("cells"),
    )
    n = F.col("rows") * F.col("cols")
    return d.select(
        "rows", "cols", "min", "max", "mean", "std", ((F.col("cells") - F.col("valid")) * 100.0 / F.col("cells")).alias("nodata_percent"), (n * 4 / 1048576.0).alias("memory_mb"),
        F.when(n <= 4_000_000, "light").when(n <= 25_000_000, "moderate").otherwise("large").alias("workload"),
        F.when((F.col("max") - F.col("min") >= 100) | (F.col("std") >= 25), "upland_steep").otherwise("flat_agricultural").alias("preset"),
        *[F.greatest(F.rint(F.lit(m / cellsize)).cast("int"), F.lit(1)).alias(n) for n, m in (("fine_px", 2.0), ("small_px", 10.0), ("broad_px", 50.0))],
    )


def preflight_text(row: dict, source: str, crs: str, warnings: tuple[str, ...] = ()) -> str:
    """A preflight row as plain text."""
    size = "large: clip it or look at a coarser preview first" if row["workload"] == "large" else row["workload"]
    lines = [
        "PREFLIGHT", f"source: {source}", f"coordinate system: {crs}", f"grid: {row['cols']:,} x {row['rows']:,} cells, {row['rows'] * row['cols']:,} in all",
        f"elevation: {row['min']:.2f} to {row['max']:.2f}, mean {row['mean']:.2f}, deviation {row['std']:.2f}", f"nodata: {row['nodata_percent']:.1f} %",
        f"memory: {row['memory_mb']:.1f} MiB a layer", f"workload: {size}", "", f"preset: {row['preset']}",
        *[f"{n}: {row[k]} px" for n, k in (("fine features", "fine_px"), ("small features", "small_px"), ("broad features", "broad_px"))],
    ]
    return "\n".join([*lines, *(["", "WARNINGS", *(f"- {w}" for w in warnings)] if warnings else []), ""])


#: So many bookmarks are kept, the newest.
BOOKMARKS = 50


def bookmark_fault() -> Column:
    """Why a row (name, x_min, y_min, x_max, y_max, crs) is no bookmark, null if it is one."""
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    open_box = F.coalesce((F.col("x_min") < F.col("x_max")) & (F.col("y_min") < F.col("y_max")), F.lit(False))
    return F.when(blank("name") | blank("crs"), "A bookmark needs a name and a coordinate system").when(~open_box, "A bookmark's extent is x_min, y_min, x_max, y_max")


def saved_bookmarks(bookmarks: DataFrame, new: DataFrame) -> DataFrame:
    """Bookmarks (name, x_min, y_min, x_max, y_max, crs, at) with new rows, each replacing its namesake; the newest ``BOOKMARKS`` stay.

    An error if a new row is none, see :func:`bookmark_fault`.
    """
    tidy = new.withColumns({"name": F.trim("name"), "crs": F.trim("crs")})
    fault = tidy.select(bookmark_fault().alias("fault")).where("fault IS NOT NULL").first()
    if fault:
        raise ValueError(fault["fault"])
    both = bookmarks.withColumn("__new", F.lit(0)).unionByName(tidy.withColumn("__new", F.lit(1)))
    of_name = Window.partitionBy("name").orderBy(F.desc("__new"), F.desc("at"))
    latest = both.withColumn("__nth", F.row_number().over(of_name)).where("__nth = 1").drop("__nth", "__new")
    return latest.orderBy(F.desc("at"), "name").limit(BOOKMARKS)


def saved_bookmark(bookmarks: DataFrame, name: str, extent: tuple[float, float, float, float], crs: str, at: str) -> DataFrame:
    """:func:`saved_bookmarks` for one bookmark."""
    row = (name, *map(float, extent), crs)
    new = bookmarks.sparkSession.createDataFrame([row], "name string, x_min double, y_min double, x_max double, y_max double, crs string").withColumn("at", F.lit(at).cast("timestamp"))
    return saved_bookmarks(bookmarks, new)


def renamed_bookmark(bookmarks: DataFrame, old: str, new: str, at: str) -> DataFrame:
    """The bookmark under another name, as the newest; an error if there is none."""
    found = bookmarks.where(F.col("name") == old).withColumns({"name": F.lit(new), "at": F.lit(at).cast("timestamp")})
    if found.isEmpty():
        raise ValueError(f"Unknown bookmark: {old}")
    return saved_bookmarks(removed_bookmark(bookmarks, old), found)


def removed_bookmark(bookmarks: DataFrame, name: str) -> DataFrame:
    return bookmarks.where(F.col("name") != name)


#: Class numbers beyond it are taken for errors of a label file.
MOST_CLASSES = 65_535


def label_names(text: str) -> list[str]:
    """Class names of a label file: a list, or an object by number whose gaps are named class_n; others give none."""
    try:
        given = json.loads(text)
    except ValueError:
        return []
    if isinstance(given, list):
        return [str(x) for x in given]
    numbered = {int(k): str(v) for k, v in given.items() if re.fullmatch(r"\d{1,9}", k) and int(k) <= MOST_CLASSES} if isinstance(given, dict) else {}
    return [numbered.get(i, f"class_{i}") for i in range(max(numbered, default=-1) + 1)]


def plain(value: object) -> object:
    """A value as JSON can hold it: numbers and texts as they are, containers by their members, anything else as text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    return plain(value.item()) if hasattr(value, "item") else str(value)


def capabilities(spark: SparkSession) -> DataFrame:
    """(name, available, detail): which optional parts can be used here; a broken one counts as missing."""
    rows = []
    for name, module in (("model inference", "onnxruntime"), ("array kernels", "numpy"), ("columnar exchange", "pyarrow"), ("frame kernels", "pandas")):
        try:
            rows.append((name, True, importlib.import_module(module).__version__))
        except Exception as error:  # any failure to load means that the part is not there
            rows.append((name, False, str(error)))
    return spark.createDataFrame(rows, "name string, available boolean, detail string")


def first_warnings(warnings: DataFrame) -> DataFrame:
    """(run, message, at): each message of a run once, where it first came up."""
    return warnings.groupBy("run", "message").agg(F.min("at").alias("at"))


def geometry_warnings(crs: Column, is_geographic: Column, pixel_w: Column, pixel_h: Column) -> Column:
    """Array of warnings about a grid's geometry."""
    longest, shortest = F.greatest(F.abs(pixel_w), F.abs(pixel_h)), F.least(F.abs(pixel_w), F.abs(pixel_h))
    return F.array_compact(F.array(
        F.when(crs.isNull() | (crs == ""), "no CRS"), F.when(is_geographic, "geographic CRS"), F.when(longest / shortest - 1 > 0.01, "pixels are not square"),
    ))


def notes(d: DataFrame) -> DataFrame:
    """Valid interpretation notes as GeoJSON features (id, feature); others are left out."""
    title, text, conf = F.trim("title"), F.trim("interpretation"), F.lower(F.trim("confidence"))
    ok = (title != "") & (text != "") & conf.isin("low", "medium", "high") & F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90)
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    properties = F.struct(title.alias("title"), text.alias("interpretation"), conf.alias("confidence"), F.trim("visualization").alias("visualization"))
    return d.where(ok).select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))).alias("feature"))


def newest(d: DataFrame, key: str, at: str, most: int) -> DataFrame:
    """The ``most`` newest entries of distinct keys, with their place: recents (8) and bookmarks (50)."""
    latest = d.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max(at).alias(at))
    w = Window.orderBy(F.col(at).desc(), key)
    return latest.orderBy(F.col(at).desc(), key).limit(most).withColumn("place", F.row_number().over(w))


def sheet_positions(names: list[str], columns: int, panel: int, gap: int = 8) -> list[tuple[str, int, int]]:
    """(panel, x, y) of a contact sheet in the order asked for."""
    return [(n, gap + (i % columns) * (panel + gap), gap + (i // columns) * (panel + gap)) for i, n in enumerate(names)]


#: Stages that a point pipeline may name.
POINT_STAGES = ("readers.las", "filters.pmf", "filters.ferry", "filters.range", "filters.outlier", "filters.csf", "filters.smrf", "writers.las", "writers.gdal")


def unknown_stages(stages: Column) -> Column:
    return F.array_except(stages, F.lit(list(POINT_STAGES)))
