"""Change detection, resampling and fusion with spectral bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.operators import horizon, stencil
from tellurian.operators.blend import MODES, aligned, clip, extremes, unit_range
from tellurian.operators.grid import grid_stats
from tellurian.operators.lineage import cut
from tellurian.operators.warp import Affine, Geo, Reprojection, warp


def detection_limit(rmse_old: float = 0.15, rmse_new: float = 0.15, confidence: float = 1.96) -> float:
    """Smallest change that the errors of both surfaces let be told from none."""
    return confidence * math.sqrt(rmse_old**2 + rmse_new**2)


def difference(old: DataFrame, new: DataFrame, limit: float) -> DataFrame:
    """(r, c, dod, mask): new less old; 1 cut, 2 fill, 0 neither, 255 where either is nodata."""
    d = old.select("r", "c", F.col("z").alias("z_old")).join(new.select("r", "c", F.col("z").alias("z_new")), ["r", "c"], "left")
    dod = F.col("z_new") - F.col("z_old")
    return d.select("r", "c", dod.alias("dod"), F.when(dod.isNull(), 255).when(dod < -limit, 1).when(dod > limit, 2).otherwise(0).alias("mask"))


def difference_report(diff: DataFrame, cell_area: float, limit: float) -> DataFrame:
    """One row: counts over valid cells, volumes over significant ones."""
    m, v = F.col("mask"), F.col("dod")
    cut = F.coalesce(F.sum(F.when(m == 1, -v)), F.lit(0.0)) * cell_area
    fill = F.coalesce(F.sum(F.when(m == 2, v)), F.lit(0.0)) * cell_area
    return diff.agg(
        F.count("dod").alias("total_cells"), F.count_if(m.isin(1, 2)).alias("significant"), F.count_if(m == 1).alias("cut_cells"), F.count_if(m == 2).alias("fill_cells"),
        cut.alias("cut_volume"), fill.alias("fill_volume"), (fill - cut).alias("net_volume"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
    ).withColumn("threshold", F.lit(limit))


def resample_nearest(cells: DataFrame, factor: float, rows: int, cols: int, value: str = "z") -> DataFrame:
    """Values on a grid ``factor`` times as fine: each target cell takes the source cell under its centre."""
    target = cells.sparkSession.range(rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    under = lambda n: F.floor((F.col(n) + 0.5) / factor)
    s = cells.select(F.col("r").alias("sr"), F.col("c").cast("long").alias("sc"), F.col(value))
    return target.select("r", "c", under("r").alias("sr"), under("c").alias("sc")).join(s, ["sr", "sc"], "left").select("r", "c", value)


def resample_bilinear(cells: DataFrame, factor: float, rows: int, cols: int, last_r: int, last_c: int) -> DataFrame:
    """Weighted mean of the four source centres around a target's centre, edges repeated; null where one is."""
    target = cells.sparkSession.range(rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("c"))
    y, x = (F.col("r") + 0.5) / factor - 0.5, (F.col("c") + 0.5) / factor - 0.5
    y0, x0 = F.floor(y), F.floor(x)
    corner = F.explode(F.array(*[F.struct((y0 + i).alias("sr"), (x0 + j).alias("sc"), ((y - y0 if i else 1 - (y - y0)) * (x - x0 if j else 1 - (x - x0))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    p = target.select("r", "c", corner.alias("k"))
    held = lambda n, last: F.greatest(F.least(F.col(f"k.{n}"), F.lit(last)), F.lit(0)).cast("long")
    p = p.select("r", "c", held("sr", last_r).alias("sr"), held("sc", last_c).alias("sc"), F.col("k.w").alias("w"))
    s = cells.select(F.col("r").alias("sr"), F.col("c").cast("long").alias("sc"), "z")
    j = p.join(s, ["sr", "sc"], "left").groupBy("r", "c").agg(F.sum(F.col("w") * F.col("z")).alias("v"), F.count("z").alias("n"))
    return j.select("r", "c", F.when(F.col("n") == 4, F.col("v")).alias("z"))


def axis_map(source_start: float, source_step: float, target_start: float, target_step: float) -> tuple[float, float]:
    """(scale, offset): target cell i has its centre at source position i * scale + offset, in whole source cells."""
    scale = target_step / source_step
    return scale, (target_start - source_start) / source_step + 0.5 * scale - 0.5


def resample(cells: DataFrame, how: str, rows: int, cols: int, map_r: tuple[float, float], map_c: tuple[float, float]) -> DataFrame:
    """(r, c, z) on any axis-parallel grid; ``map_r`` and ``map_c`` are those of :func:`axis_map`, ``how`` is one of ``warp.KERNELS``."""
    return warp(cells, Affine(map_r, map_c), rows, cols, how)


def match_grid(cells: DataFrame, source: Geo, target: Geo, rows: int, cols: int, how: str = "bilinear", source_crs: str | None = None, target_crs: str | None = None) -> DataFrame:
    """Cells on another grid, also of another coordinate system; grids are (x0, cell width, y0, cell height).

    Systems are authority ids (see ``project.system``); without both of them, or
    with the same twice, the grids share one.
    """
    if source_crs and target_crs and source_crs.upper() != target_crs.upper():
        return warp(cells, Reprojection(source, source_crs, target, target_crs), rows, cols, how)
    map_c, map_r = axis_map(source[0], source[1], target[0], target[1]), axis_map(source[2], source[3], target[2], target[3])
    return resample(cells, how, rows, cols, map_r, map_c)


def misalignment(crs_a: Column, crs_b: Column, extent_a: Column, extent_b: Column) -> Column:
    """Why two rasters may not be combined cell by cell, null if they may: other coordinate systems or extents.

    Extents are structs (x_min, y_min, x_max, y_max); they may differ by a
    millionth of the longest side.  An unknown coordinate system is no obstacle.
    """
    names = ("x_min", "y_min", "x_max", "y_max")
    side = lambda e, a, b: e[b] - e[a]
    longest = F.greatest(side(extent_a, "x_min", "x_max"), side(extent_a, "y_min", "y_max"), side(extent_b, "x_min", "x_max"), side(extent_b, "y_min", "y_max"), F.lit(1.0))
    apart = F.greatest(*[F.abs(extent_a[n] - extent_b[n]) for n in names]) > 1e-6 * longest
    return F.when(crs_a != crs_b, F.concat(F.lit("coordinate systems differ: "), crs_a, F.lit(", "), crs_b)).when(apart, "extents differ")


def difference_on_grid(old: DataFrame, new: DataFrame, old_geo: Geo, new_geo: Geo, limit: float, how: str = "bilinear", old_crs: str | None = None, new_crs: str | None = None) -> DataFrame:
    """:func:`difference` after bringing the new surface onto the old one's grid and coordinate system."""
    s = grid_stats(old)
    matched = match_grid(new, new_geo, old_geo, s.last_r + 1, s.last_c + 1, how, new_crs, old_crs)
    return difference(old, matched, limit)


#: Aggregating resamplers by name.
AGGREGATES = {
    "average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "mode": lambda c: F.mode(c, deterministic=True), "median": F.median,
    "q1": lambda c: F.percentile(c, F.lit(0.25)), "q3": lambda c: F.percentile(c, F.lit(0.75)), "rms": lambda c: F.sqrt(F.avg(F.col(c) * F.col(c))),
}


def resample_aggregate(cells: DataFrame, factor: int, how: str) -> DataFrame:
    """Cells of a grid ``factor`` times as coarse from the valid cells inside them."""
    if how not in AGGREGATES:
        raise ValueError(f"Unknown resampling method: {how}")
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c")).agg(AGGREGATES[how]("z").alias("z"))


#: Spectral bands (name, description, resolution in metres, centre in nanometres).
SPECTRAL_BANDS = (
    ("B2", "Blue", 10, 490), ("B3", "Green", 10, 560), ("B4", "Red", 10, 665), ("B5", "Vegetation Red Edge", 20, 705), ("B6", "Vegetation Red Edge", 20, 740),
    ("B7", "Vegetation Red Edge", 20, 783), ("B8", "NIR", 10, 842), ("B8A", "Narrow NIR", 20, 865), ("B11", "SWIR 1", 20, 1610), ("B12", "SWIR 2", 20, 2190),
)

#: Recipe -> (relief layer, bands, blend, opacity of the relief).
FUSION_RECIPES = {
    "terrain_cir": ("svf", ("B8", "B4", "B3"), "luminance_overlay", 0.6),
    "crop_marks": ("local_dominance", ("B4", "B3", "B2"), "overlay", 0.5),
    "erosion_risk": ("slope", ("B11", "B8", "B4"), "multiply", 0.7),
    "bare_earth": ("slrm", ("B11", "B12", "B4"), "screen", 0.5),
}


def missing_bands(recipe: str, provided: list[str]) -> list[str]:
    """Bands that a recipe needs and a caller lacks."""
    return [b for b in FUSION_RECIPES[recipe][1] if b not in provided]


def relief_layer(cells: DataFrame, cellsize: float, layer: str) -> DataFrame:
    """(r, c, layer): a recipe's relief layer with the operators' own radii."""
    make = {"svf": horizon.sky_view_factor, "local_dominance": horizon.local_dominance, "slope": stencil.slope, "slrm": lambda d, _: stencil.local_relief(d)}
    return make[layer](cells, cellsize)


def fusion(cells: DataFrame, bands: DataFrame, recipe: str, cellsize: float) -> DataFrame:
    """red, green, blue of a recipe: its relief layer of the surface with its bands (columns b2, b3, ...) of the same grid."""
    layer, names, mode, opacity = FUSION_RECIPES[recipe]
    if missing := missing_bands(recipe, [n.upper() for n in bands.columns]):
        raise ValueError(f"{recipe} needs {', '.join(missing)}")
    columns = tuple(n.lower() for n in names)
    # Read twice, for the layers' ranges and for the result.
    d = cut(aligned(relief_layer(cells, cellsize, layer), bands.select("r", "c", *columns)))
    return fuse(d, layer, columns, mode, opacity)


def _fused(mode: str, relief: Column, band: Column, opacity: float) -> Column:
    if mode == "luminance_overlay":
        return relief * (1 - opacity) + relief * band * opacity
    return (1 - opacity) * band + opacity * MODES[mode](relief, band)


def fuse(d: DataFrame, relief: str, bands: tuple[str, str, str], mode: str, opacity: float) -> DataFrame:
    """red, green, blue bytes of a relief layer blended with three bands; each layer scaled to its range."""
    if mode not in (*MODES, "luminance_overlay"):
        raise ValueError(f"Unknown blend mode: {mode}")
    e = extremes(d, relief, *bands)
    unit = {n: unit_range(F.col(n), *e[n], least=1e-10) for n in (relief, *bands)}
    byte = lambda b: F.coalesce(clip(_fused(mode, unit[relief], unit[b], opacity) * 255.0, 0.0, 255.0), F.lit(0.0)).cast("int")
    return d.select("r", "c", *[byte(b).alias(n) for n, b in zip(("red", "green", "blue"), bands, strict=True)])
