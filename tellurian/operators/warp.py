"""Resampling of a grid to any other: affine maps by two passes along the axes, others cell by cell, tile by tile.

A tile of the target knows from a few control points which part of the source it
reads; source cells go to the tiles that read them (one shuffle) and a numpy
kernel makes the tile.  A tile reads about as many source cells as it has cells
of its own, times the ratio of cell sizes, and tiles are made smaller on coarser
grids, so that its memory is bounded.

Weights of valid cells inside the source add up to one; a target is null where
the source cell under its centre is null or there is none.  On a coarser grid
the kernel is stretched with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurian.operators.project import reproject_arrays

#: Cells on the side of a target tile, and of the part of the source that one may read.
TILE = 256
READ = 1024
#: Control points along each side of a tile.
CONTROL = 5

Geo = tuple[float, float, float, float]


def _bilinear(t: np.ndarray) -> np.ndarray:
    return np.maximum(1 - t, 0)


def _cubic(t: np.ndarray) -> np.ndarray:
    return np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))


def _cubic_spline(t: np.ndarray) -> np.ndarray:
    return np.where(t < 1, (4 - 6 * t * t + 3 * t * t * t) / 6, np.where(t < 2, (2 - t) ** 3 / 6, 0))


def _lanczos(t: np.ndarray) -> np.ndarray:
    return np.where(t < 3, np.sinc(t) * np.sinc(t / 3), 0)


#: Weight at a distance in source cells, and how far it reaches; the nearest cell is the one under the centre.
KERNELS = {"nearest": (None, 0), "bilinear": (_bilinear, 1), "cubic": (_cubic, 2), "cubic_spline": (_cubic_spline, 2), "lanczos": (_lanczos, 3)}


@dataclass(frozen=True)
class Affine:
    """Target row and column to source position, in whole source cells: (scale, offset) for each axis."""

    row: tuple[float, float]
    col: tuple[float, float]

    def at(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return r * self.row[0] + self.row[1], c * self.col[0] + self.col[1]

    def scales(self, rows: int, cols: int) -> tuple[float, float]:
        return abs(self.row[0]), abs(self.col[0])


@dataclass(frozen=True)
class Reprojection:
    """Target cells to positions on a source grid of another coordinate system; grids are (x0, cell width, y0, cell height)."""

    source: Geo
    source_crs: str
    target: Geo
    target_crs: str

    def at(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x0, pw, y0, ph = self.target
        x, y = reproject_arrays(x0 + (c + 0.5) * pw, y0 + (r + 0.5) * ph, self.target_crs, self.source_crs)
        x0, pw, y0, ph = self.source
        return (y - y0) / ph - 0.5, (x - x0) / pw - 0.5

    def scales(self, rows: int, cols: int) -> tuple[float, float]:
        """Source cells that a target cell spans, at the middle of the target: one number for all tiles."""
        r, c = np.array([rows / 2, rows / 2 + 1, rows / 2]), np.array([cols / 2, cols / 2, cols / 2 + 1])
        pr, pc = self.at(r, c)
        return max(abs(pr[1] - pr[0]), abs(pr[2] - pr[0])), max(abs(pc[1] - pc[0]), abs(pc[2] - pc[0]))


Map = Affine | Reprojection


def _reads(where: Map, r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray, reach: tuple[int, int]) -> np.ndarray:
    """(tile, 4): first and last source row and column that the kernel of each tile reads.

    The map is smooth, so between control points it leaves their hull by no more
    than an eighth of its second difference; twice that, over both axes, is added.
    """
    t = np.linspace(0, 1, CONTROL)
    rr = (r0[:, None] + (r1 - r0)[:, None] * t)[:, :, None]
    cc = (c0[:, None] + (c1 - c0)[:, None] * t)[:, None, :]
    out = []
    for p, far in zip(where.at(*np.broadcast_arrays(rr.astype(float), cc.astype(float))), reach, strict=True):
        sag = (np.abs(np.diff(p, 2, axis=1)).max(axis=(1, 2)) + np.abs(np.diff(p, 2, axis=2)).max(axis=(1, 2))) / 4
        out += [np.floor(p.min(axis=(1, 2)) - sag) - far - 1, np.ceil(p.max(axis=(1, 2)) + sag) + far + 1]
    return np.stack(out, axis=1)


def warp(cells: DataFrame, where: Map, rows: int, cols: int, how: str = "bilinear", value: str = "z") -> DataFrame:
    """(r, c, value) on a target of ``rows`` x ``cols`` cells; see the module."""
    if how not in KERNELS:
        raise ValueError(f"Unknown resampling method: {how}")
    weight, span = KERNELS[how]
    wide = tuple(max(1.0, s) for s in where.scales(rows, cols))
    reach = tuple(math.ceil(span * w) for w in wide)
    tile = max(1, min(TILE, int(READ / max(wide))))
    part = max(1, min(TILE, READ))
    across = -(-cols // tile)
    n_tiles = -(-rows // tile) * across

    def bounds(ids: np.ndarray) -> tuple[np.ndarray, ...]:
        r0, c0 = ids // across * tile, ids % across * tile
        return r0, np.minimum(r0 + tile, rows) - 1, c0, np.minimum(c0 + tile, cols) - 1

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy()
            if not len(ids):
                continue
            box = _reads(where, *bounds(ids), reach)
            sound = np.isfinite(box).all(axis=1)
            # Beyond these no grid has cells.
            box = np.clip(np.where(sound[:, None], box, 0), -(1 << 31), 1 << 31).astype(np.int64) // part
            for i, (a, z, f, g) in zip(ids.tolist(), box.tolist(), strict=True):
                r, c = np.meshgrid(np.arange(a, z + 1), np.arange(f, g + 1), indexing="ij")
                yield pa.RecordBatch.from_pydict({"tile": np.full(r.size, i), "pr": r.ravel(), "pc": c.ravel()})

    spark = cells.sparkSession
    tiles = spark.range(n_tiles)
    wants = tiles.mapInArrow(plan, "tile long, pr long, pc long")
    given = cells.where(F.col(value).isNotNull()).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("z"))
    sent = given.withColumns({"pr": F.floor(F.col("r") / part), "pc": F.floor(F.col("c") / part)}).join(wants, ["pr", "pc"]).select("tile", "r", "c", "z")
    make = _two_passes if isinstance(where, Affine) and weight is not None else _cell_by_cell

    def kernel(asked: pa.Table, met: pa.Table) -> pa.Table:
        ids = asked["id"].to_numpy()
        (r0,), (r1,), (c0,), (c1,) = bounds(ids)
        out = np.full((r1 - r0 + 1, c1 - c0 + 1), np.nan)
        box = _reads(where, *bounds(ids), reach)[0]
        # Where the map has no value the target has none.
        if len(met) and np.isfinite(box).all():
            box = box.astype(np.int64)
            sr, sc, z = (met[n].to_numpy() for n in ("r", "c", "z"))
            near = (sr >= box[0]) & (sr <= box[1]) & (sc >= box[2]) & (sc <= box[3])
            if near.any():
                source = np.full((box[1] - box[0] + 1, box[3] - box[2] + 1), np.nan)
                source[sr[near] - box[0], sc[near] - box[2]] = z[near]
                out = make(source, (box[0], box[2]), where, np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), weight, wide, reach)
        r, c = np.meshgrid(np.arange(r0, r1 + 1), np.arange(c0, c1 + 1), indexing="ij")
        return pa.table({"r": r.ravel(), "c": c.ravel(), value: pa.array(out.ravel(), mask=np.isnan(out.ravel()))})

    return tiles.groupBy("id").cogroup(sent.groupBy("tile")).applyInArrow(kernel, f"r long, c long, {value} double")


def _taps(p: np.ndarray, far: int, wide: float, weight: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(source place, weight) of each tap of positions ``p``."""
    base = np.floor(p)
    for k in range(1 - far, far + 1):
        yield (base + k).astype(np.int64), weight(np.abs(base + k - p) / wide)


def _two_passes(source: np.ndarray, origin: tuple[int, int], where: Affine, r: np.ndarray, c: np.ndarray, weight: Callable, wide: tuple[float, float], reach: tuple[int, int]) -> np.ndarray:
    """The sums of weighted values and of weights, first along rows, then along columns: 2 x 2 reach steps a cell."""
    pr, pc = where.at(r.astype(float), c.astype(float))
    pr, pc = pr - origin[0], pc - origin[1]
    valid = ~np.isnan(source)
    layers = [np.where(valid, source, 0.0), valid.astype(float)]
    thin = [np.zeros((source.shape[0], len(c))) for _ in layers]
    for place, w in _taps(pc, reach[1], wide[1], weight):
        for t, a in zip(thin, layers, strict=True):
            t += w * a[:, place]
    done = [np.zeros((len(r), len(c))) for _ in layers]
    for place, w in _taps(pr, reach[0], wide[0], weight):
        for t, a in zip(done, thin, strict=True):
            t += w[:, None] * a[place]
    known = valid[np.ix_(np.floor(pr + 0.5).astype(np.int64), np.floor(pc + 0.5).astype(np.int64))]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(known & (np.abs(done[1]) > 1e-12), done[0] / done[1], np.nan)


def _cell_by_cell(source: np.ndarray, origin: tuple[int, int], where: Map, r: np.ndarray, c: np.ndarray, weight: Callable | None, wide: tuple[float, float], reach: tuple[int, int]) -> np.ndarray:
    pr, pc = where.at(*(a.astype(float) for a in np.meshgrid(r, c, indexing="ij")))
    pr, pc = pr - origin[0], pc - origin[1]
    for p, far, size in zip((pr, pc), reach, source.shape, strict=True):
        if not (p.min() >= far and p.max() < size - far - 1):
            raise ValueError("The map bends more inside a tile than its control points show")
    under = source[np.floor(pr + 0.5).astype(np.int64), np.floor(pc + 0.5).astype(np.int64)]
    if weight is None:
        return under
    total, value = np.zeros(pr.shape), np.zeros(pr.shape)
    for i, wr in _taps(pr, reach[0], wide[0], weight):
        for j, wc in _taps(pc, reach[1], wide[1], weight):
            z, w = source[i, j], wr * wc
            known = ~np.isnan(z)
            value += np.where(known, w * z, 0)
            total += np.where(known, w, 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(~np.isnan(under) & (np.abs(total) > 1e-12), value / total, np.nan)
