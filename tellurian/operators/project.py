"""Coordinate systems: transverse Mercator by Krueger's series, both ways, on columns or arrays.

Formulas are lists of steps, each a function of the steps before it.  On a
DataFrame every step is a column of its own, so that nothing is computed twice;
on arrays they run one after the other.  Series are cut after the fourth power of
the third flattening (the sixth for latitudes), which leaves less than a
micrometre inside a zone.

Systems share one datum: there are no datum shifts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and flattening of the ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563

_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))


def _powers(*rows: tuple[float, ...]) -> list[float]:
    """Row j, from 1 on, holds the factors of n**j, n**(j + 1) ..."""
    return [sum(f * _N ** (j + k) for k, f in enumerate(row)) for j, row in enumerate(rows, 1)]


#: Krueger's coefficients for the way out, the way back, and from conformal to geographic latitude.
_OUT = _powers((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
_BACK = _powers((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
_LATITUDE = _powers(
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675), (7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945), (56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (4279 / 630, -332 / 35, -399572 / 14175), (4174 / 315, -144838 / 6237), (601676 / 22275,),
)
#: A quarter meridian is a right angle times this.
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)

_COLUMN = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, sinh=F.sinh, cosh=F.cosh, asinh=F.asinh, atanh=F.atanh, atan=F.atan, atan2=F.atan2, exp=F.exp, sqrt=F.sqrt)
_ARRAY = SimpleNamespace(sin=np.sin, cos=np.cos, tan=np.tan, sinh=np.sinh, cosh=np.cosh, asinh=np.arcsinh, atanh=np.arctanh, atan=np.arctan, atan2=np.arctan2, exp=np.exp, sqrt=np.sqrt)

Step = tuple[str, Callable[[Any, Callable[[str], Any]], Any]]


@dataclass(frozen=True)
class System:
    """A coordinate system: degrees, a transverse Mercator, or the spherical Mercator of web maps."""

    kind: str
    meridian: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0

    def to_degrees(self) -> list[Step]:
        """Steps from x and y to lon and lat."""
        if self.kind == "degrees":
            return [("lon", lambda m, v: v("x")), ("lat", lambda m, v: v("y"))]
        if self.kind == "web":
            return [("lon", lambda m, v: v("x") / AXIS * (180 / math.pi)), ("lat", lambda m, v: m.atan(m.sinh(v("y") / AXIS)) * (180 / math.pi))]
        whole = self.scale * _RADIUS
        return [
            ("xi", lambda m, v: (v("y") - self.north) / whole),
            ("eta", lambda m, v: (v("x") - self.east) / whole),
            ("xi1", lambda m, v: v("xi") - sum(b * m.sin(2 * j * v("xi")) * m.cosh(2 * j * v("eta")) for j, b in enumerate(_BACK, 1))),
            ("eta1", lambda m, v: v("eta") - sum(b * m.cos(2 * j * v("xi")) * m.sinh(2 * j * v("eta")) for j, b in enumerate(_BACK, 1))),
            ("lon", lambda m, v: self.meridian + m.atan2(m.sinh(v("eta1")), m.cos(v("xi1"))) * (180 / math.pi)),
            ("chi", lambda m, v: m.atan2(m.sin(v("xi1")), m.sqrt(m.sinh(v("eta1")) * m.sinh(v("eta1")) + m.cos(v("xi1")) * m.cos(v("xi1"))))),
            ("lat", lambda m, v: (v("chi") + sum(d * m.sin(2 * j * v("chi")) for j, d in enumerate(_LATITUDE, 1))) * (180 / math.pi)),
        ]

    def from_degrees(self) -> list[Step]:
        """Steps from lon and lat to x and y."""
        if self.kind == "degrees":
            return [("x", lambda m, v: v("lon")), ("y", lambda m, v: v("lat"))]
        if self.kind == "web":
            return [("x", lambda m, v: v("lon") * (math.pi / 180) * AXIS), ("y", lambda m, v: m.asinh(m.tan(v("lat") * (math.pi / 180))) * AXIS)]
        whole = self.scale * _RADIUS
        return [
            ("phi", lambda m, v: v("lat") * (math.pi / 180)),
            ("lam", lambda m, v: (v("lon") - self.meridian) * (math.pi / 180)),
            ("t", lambda m, v: m.sinh(m.asinh(m.tan(v("phi"))) - _E * m.atanh(_E * m.sin(v("phi"))))),
            ("xi1", lambda m, v: m.atan2(v("t"), m.cos(v("lam")))),
            ("eta1", lambda m, v: m.asinh(m.sin(v("lam")) / m.sqrt(v("t") * v("t") + m.cos(v("lam")) * m.cos(v("lam"))))),
            ("x", lambda m, v: self.east + whole * (v("eta1") + sum(a * m.cos(2 * j * v("xi1")) * m.sinh(2 * j * v("eta1")) for j, a in enumerate(_OUT, 1)))),
            ("y", lambda m, v: self.north + whole * (v("xi1") + sum(a * m.sin(2 * j * v("xi1")) * m.cosh(2 * j * v("eta1")) for j, a in enumerate(_OUT, 1)))),
        ]


def system(authority: str) -> System:
    """The system of an authority id: EPSG:4326 (degrees), 3857 (web), 326zz, 327zz and 258zz (zones of six degrees)."""
    name, _, code = authority.upper().partition(":")
    if name == "EPSG" and code in ("4326", "4258"):
        return System("degrees")
    if name == "EPSG" and code == "3857":
        return System("web")
    if name == "EPSG" and len(code) == 5 and code[:3] in ("326", "327", "258") and 1 <= int(code[3:]) <= 60:
        return System("mercator", 6.0 * int(code[3:]) - 183.0, 0.9996, 500_000.0, 10_000_000.0 if code[:3] == "327" else 0.0)
    raise ValueError(f"Unknown coordinate system: {authority}")


def reproject(points: DataFrame, source: str, target: str, x: str = "x", y: str = "y", out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Adds (or replaces) the ``out`` columns: ``x`` and ``y`` of the source system in the target system.

    Null coordinates stay null.  All of it is built-in functions on columns.
    """
    kept = [n for n in points.columns if n not in out]
    d = points.select(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(kept)], F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    for name, step in system(source).to_degrees() + system(target).from_degrees():
        d = d.withColumn(name, step(_COLUMN, F.col))
    return d.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(kept)], F.col("x").alias(out[0]), F.col("y").alias(out[1]))


def reproject_arrays(x: np.ndarray, y: np.ndarray, source: str, target: str) -> tuple[np.ndarray, np.ndarray]:
    """:func:`reproject` on arrays."""
    v = {"x": np.asarray(x, float), "y": np.asarray(y, float)}
    for name, step in system(source).to_degrees() + system(target).from_degrees():
        v[name] = step(_ARRAY, v.__getitem__)
    return v["x"], v["y"]
