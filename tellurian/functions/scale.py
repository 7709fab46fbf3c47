"""Radii in pixels and metres, and terrain presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Radii beyond this many pixels are slow enough to warn about.
SLOW_RADIUS = 200

#: Presets in metres (sky view, openness and trend radius, dominance from/to, eye height, directions, noise).
PRESETS = {
    "flat_agricultural": {"svf": 20.0, "openness": 15.0, "slrm": 20.0, "ld_min": 10.0, "ld_max": 20.0, "observer": 1.7, "directions": 16, "noise": 1},
    "forested": {"svf": 10.0, "openness": 5.0, "slrm": 12.0, "ld_min": 5.0, "ld_max": 15.0, "observer": 1.5, "directions": 16, "noise": 3},
    "upland_steep": {"svf": 5.0, "openness": 5.0, "slrm": 8.0, "ld_min": 5.0, "ld_max": 10.0, "observer": 1.0, "directions": 16, "noise": 2},
    "coastal": {"svf": 15.0, "openness": 10.0, "slrm": 25.0, "ld_min": 15.0, "ld_max": 30.0, "observer": 2.0, "directions": 32, "noise": 1},
}
_DISTANCES = ("svf", "openness", "slrm", "ld_min", "ld_max")


def pixels(value: Column, units: str, cellsize: Column, least: int = 1, most: int | None = None) -> Column:
    """A radius as whole pixels: rounded half to even, at least ``least``."""
    if units not in ("pixels", "metres"):
        raise ValueError(f"Unknown radius units: {units}")
    n = F.greatest(F.rint(value if units == "pixels" else value / cellsize).cast("int"), F.lit(least))
    return n if most is None else F.least(n, F.lit(most))


def describe(px: Column, cellsize: Column) -> Column:
    """Such as ``20 px = 5.0 m``."""
    return F.format_string("%d px = %.1f m", px, px * cellsize)


def too_slow(px: Column) -> Column:
    return px > SLOW_RADIUS


def preset_table(spark: SparkSession) -> DataFrame:
    """One row per preset, distances in metres."""
    names = list(next(iter(PRESETS.values())))
    kinds = ", ".join(f"{n} {'int' if n in ('directions', 'noise') else 'double'}" for n in names)
    return spark.createDataFrame([(k, *(v[n] for n in names)) for k, v in PRESETS.items()], f"preset string, {kinds}")


def presets(spark: SparkSession, cellsize: float) -> DataFrame:
    """Presets in pixels of this cell size; dominance keeps a ring of at least one pixel."""
    if cellsize <= 0:
        raise ValueError("cellsize must be positive")
    d = preset_table(spark).withColumns({n: pixels(F.col(n), "metres", F.lit(cellsize)) for n in _DISTANCES})
    return d.withColumn("ld_max", F.greatest("ld_max", F.col("ld_min") + 1))


def preset(name: str, cellsize: float = 1.0) -> dict:
    """One preset in pixels, as plain values."""
    if name not in PRESETS:
        raise ValueError(f"Unknown preset: {name}")
    if cellsize <= 0:
        raise ValueError("cellsize must be positive")
    p = {k: max(1, round(v / cellsize)) if k in _DISTANCES else v for k, v in PRESETS[name].items()}
    return p | {"ld_max": max(p["ld_max"], p["ld_min"] + 1)}
