"""Point clouds (x, y, z): gridding, outliers and ground filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurian.operators import cloth
from tellurian.operators.grid import haloed
from tellurian.operators.lineage import cut
from tellurian.operators.nearest import nearest as nearest_points

#: Fixed value: no side of a gridded surface may have more cells.
MAX_SIDE = 20_000


def grid_geometry(points: DataFrame, cellsize: float) -> tuple[float, float, int, int]:
    """(x of the left edge, y of the top edge, rows, cols): the extent padded by half a cell."""
    if cellsize <= 0:
        raise ValueError("cellsize must be positive")
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if x0 is None:
        raise ValueError("Cannot grid an empty cloud")
    cols, rows = int((x1 - x0 + cellsize) / cellsize) + 1, int((y1 - y0 + cellsize) / cellsize) + 1
    if max(rows, cols) > MAX_SIDE:
        raise ValueError(f"A grid of {cols} x {rows} cells exceeds {MAX_SIDE} a side")
    return x0 - cellsize / 2, y1 + cellsize / 2, rows, cols


#: A tile is made smaller until the densest one has no more points than this.
TILE_POINTS = 1 << 18


def _tile_side(points: DataFrame, side: float, least: float) -> float:
    """``side`` halved until the densest square holds at most ``TILE_POINTS``, by one small aggregate."""
    square = lambda n: F.floor(F.col(n) / side)
    densest = points.groupBy(square("x").alias("sx"), square("y").alias("sy")).count().agg(F.max("count")).first()[0] or 0
    while densest > TILE_POINTS and side / 2 >= least:
        densest, side = densest / 4, side / 2
    return side


def grid_idw(points: DataFrame, cellsize: float, radius: float | None = None, nearest: int = 12, smoothing: float = 1.0, tile: int = 64) -> DataFrame:
    """(r, c, z): inverse squared distance of the nearest points within the radius, else NULL.

    Points are sent once to each tile of cells that they can reach (one shuffle)
    and looked up there by rings of buckets, so that a cell meets about as many
    points as it uses and not all of its neighbourhood.  Every tile also gets a
    marker without coordinates, and so answers for its cells even without points.
    Where so many points crowd that a halo would outgrow memory, cells are asked
    in rounds instead, see :func:`_crowded_idw`.
    """
    left, top, rows, cols = grid_geometry(points, cellsize)
    reach = radius or 5.0 * cellsize
    heaviest = points.groupBy(F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)).count().agg(F.max("count")).first()[0]
    # A tile no wider than the reach meets sixteen such squares with its halo.
    if 16 * heaviest > TILE_POINTS:
        return _crowded_idw(points, cellsize, (left, top, rows, cols), reach, nearest, smoothing, heaviest)
    tile = max(1, int(_tile_side(points, tile * cellsize, cellsize) / cellsize))
    place = lambda v: F.floor(v / cellsize / tile)
    span = lambda v, n: F.sequence(F.greatest(place(v - reach), F.lit(0)), F.least(place(v + reach), F.lit((n - 1) // tile)))
    p = points.select("x", "y", "z").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    sent = p.withColumn("tile_c", F.explode(span(F.col("x") - left, cols))).withColumn("tile_r", F.explode(span(top - F.col("y"), rows)))
    marks = points.sparkSession.range((rows - 1) // tile + 1).select(F.lit(None).cast("double").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit((cols - 1) // tile).cast("long"))).alias("tile_c"), F.col("id").alias("tile_r"))
    marks = marks.select("x", F.col("x").alias("y"), F.col("x").alias("z"), "tile_c", "tile_r")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_r"].iat[0]) * tile, int(pdf["tile_c"].iat[0]) * tile
        r, c = (a.ravel() for a in np.mgrid[r0 : min(r0 + tile, rows), c0 : min(c0 + tile, cols)])
        x, y, z = (pdf[n].to_numpy(float) for n in "xyz")
        known = ~np.isnan(x)
        x, y, z = x[known], y[known], z[known]
        q, at, d2 = nearest_points(x, y, z, left + (c + 0.5) * cellsize, top - (r + 0.5) * cellsize, nearest, reach)
        w = 1.0 / (d2 + smoothing * smoothing)
        with np.errstate(invalid="ignore"):
            out = np.bincount(q, w * z[at], len(r)) / np.bincount(q, w, len(r))
        return pd.DataFrame({"r": r, "c": c.astype(np.int32), "z": out})

    made = sent.unionByName(marks).groupBy("tile_r", "tile_c").applyInPandas(fill, "r long, c int, z double")
    return made.select("r", "c", F.when(~F.isnan("z"), F.col("z")).alias("z"))


def _crowded_idw(points: DataFrame, cellsize: float, geometry: tuple[float, float, int, int], reach: float, nearest: int, smoothing: float, heaviest: int) -> DataFrame:
    """:func:`grid_idw` of a cloud with ``heaviest`` points in a square as wide as the reach, with no tile held anywhere.

    A round takes the points within a small distance of each centre, of which
    ranks let no more than ``nearest`` through; cells that find as many are
    settled, the others are asked again with twice the distance.
    """
    left, top, rows, cols = geometry
    p = points.select("x", "y", "z").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    p = p.withColumns({"own_r": F.floor((top - F.col("y")) / cellsize), "own_c": F.floor((F.col("x") - left) / cellsize)})
    cells = points.sparkSession.range(rows).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("c"))
    dx, dy = F.col("x") - (left + (F.col("c") + 0.5) * cellsize), F.col("y") - (top - (F.col("r") + 0.5) * cellsize)
    rank = F.row_number().over(Window.partitionBy("r", "c").orderBy("d2", "z", "x", "y"))
    weight = 1.0 / (F.col("d2") + smoothing * smoothing)
    # About four times as many points as are wanted, in the heaviest square.
    near = min(reach, cellsize / 2, reach * float(np.sqrt(4 * nearest / np.pi / heaviest)))
    done, asked = None, None
    while True:
        if asked is None:
            met = p.select("x", "y", "z", F.col("own_r").alias("r"), F.col("own_c").alias("c"))
        else:
            steps = F.sequence(*(F.lit(k * int(near / cellsize + 0.5 + 1e-9)).cast("long") for k in (-1, 1)))
            around = asked.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps))
            met = p.join(around.select("r", "c", (F.col("r") + F.col("dr")).alias("own_r"), (F.col("c") + F.col("dc")).alias("own_c")), ["own_r", "own_c"])
        best = met.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= near * near).withColumn("rank", rank).where(F.col("rank") <= nearest)
        rated = cut(best.groupBy("r", "c").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("z"), F.count(F.lit(1)).alias("n")))
        settled = rated.where(F.col("n") >= nearest) if near < reach else rated
        done = settled if done is None else done.unionByName(settled)
        asked = cut((cells if asked is None else asked).join(settled, ["r", "c"], "left_anti"))
        if near >= reach or asked.isEmpty():
            break
        near = min(reach, near * 2)
    return cells.join(done.select("r", "c", "z"), ["r", "c"], "left").select("r", F.col("c").cast("int").alias("c"), "z")


def _rater(neighbours: int, reach: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Mean distances of a tile's own queries; settled are those whose neighbours are all within ``reach``."""

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (pdf[n].to_numpy(float) for n in "xyz")
        mine = pdf["own"].to_numpy(bool)
        # The queries stand first, so that their numbers are those of their points.
        order = np.argsort(~mine, kind="stable")
        x, y, z, n = x[order], y[order], z[order], int(mine.sum())
        q, _, d2 = nearest_points(x, y, z, x[:n], y[:n], neighbours, reach, z[:n], skip_self=True)
        found = np.bincount(q, minlength=n)
        with np.errstate(invalid="ignore"):
            mean = np.bincount(q, np.sqrt(d2), n) / found
        return pd.DataFrame({"id": pdf["id"].to_numpy()[order][:n], "mean_distance": mean, "settled": (found >= neighbours) | ~np.isfinite(reach)})

    return rate


#: Rounds go on with a wider reach while more than this share of the points is unanswered; the rest is searched for tile by tile.
SPARSE_SHARE = 1 / 64


def outliers(points: DataFrame, bucket: float, neighbours: int = 8, multiplier: float = 2.0) -> DataFrame:
    """(id, mean_distance, is_outlier): mean distance in space to the nearest points, against the cloud's.

    A round sends the points to each square tile of the plane that they lie within
    ``bucket`` of; a query is answered where its neighbours are all nearer than
    that.  While many are left, the next round has tiles and reach eight times as
    wide; the few in sparse parts then look for the tiles that can hold their
    neighbours, see :func:`_nearest_tiles`, and only those tiles' points move.  In a
    crowd the first reach is halved until a tile and its halo fit into memory, and
    no wider one that would not is tried.  A
    point that has no other at all is an outlier.
    """
    p = cut(points.select("id", "x", "y", "z").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"))
    n, x0, x1, y0, y1, z0, z1 = p.agg(F.count("id"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("z"), F.max("z")).first()
    done = None
    # In a crowd the neighbours are near; a tile as wide as the reach has nine such squares with its halo.
    crowded = lambda reach: 9 * ((p.groupBy(F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)).count().agg(F.max("count")).first()[0]) or 0) > TILE_POINTS
    first = bucket
    while first > bucket / 1024 and crowded(first):
        first /= 2
    asked, reach = p.select("id"), first
    while True:
        whole = x0 is None or reach >= np.hypot(np.hypot(x1 - x0, y1 - y0), z1 - z0)
        side = _tile_side(p, 4 * reach, reach)
        span = lambda n, r=reach, w=side: F.sequence(F.floor((F.col(n) - r) / w), F.floor((F.col(n) + r) / w))
        marked = p.join(asked.withColumn("query", F.lit(True)), "id", "left") if done is not None else p.withColumn("query", F.lit(True))
        own = (F.floor(F.col("x") / side) == F.col("tx")) & (F.floor(F.col("y") / side) == F.col("ty")) & F.coalesce("query", F.lit(False))
        sent = marked.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y"))).withColumn("own", own)

        rated = cut(sent.groupBy("tx", "ty").applyInPandas(_rater(neighbours, np.inf if whole else reach), "id long, mean_distance double, settled boolean"))
        part = rated.where("settled").select("id", F.when(~F.isnan("mean_distance"), F.col("mean_distance")).alias("mean_distance"))
        done = part if done is None else done.unionByName(part)
        asked, reach = rated.where("NOT settled").select("id"), reach * 8
        left = 0 if whole else asked.count()
        if left <= n * SPARSE_SHARE or (first < bucket and crowded(reach)):
            break
    if left:
        # Tiles as small as the first round's, so that a lone point moves no more than the rim of the cloud.
        side = _tile_side(p, 4 * first, first)
        done = done.unionByName(_sparse_distances(p, p.join(asked, "id", "left_semi"), side, neighbours))
    mean, std = done.agg(F.avg("mean_distance"), F.stddev_samp("mean_distance")).first()
    limit = float("inf") if mean is None else mean + multiplier * (std or 0.0)
    found = points.select("id").join(done, "id", "left")
    return found.select("id", "mean_distance", (F.col("mean_distance").isNull() | (F.col("mean_distance") > limit)).alias("is_outlier"))


_BOX = ("x0", "x1", "y0", "y1", "z0", "z1")


def _nearest_tiles(p: DataFrame, queries: DataFrame, side: float, neighbours: int) -> DataFrame:
    """(id, x, y, z, tx, ty): the tiles that can hold one of the ``neighbours`` nearest points of each query.

    Tiles carry their count and the box of their points, and four of them make one
    of the next level.  From the top down, a query keeps the tiles that are no
    farther off than the distance within which it is sure to find enough points,
    that is the farthest corners of the nearest tiles with as many; the tiles it
    keeps are replaced by those they are made of.
    """
    tile = lambda n: F.floor(F.col(n) / side)
    ends = [f(n).alias(f"{n}{k}") for n in "xyz" for k, f in ((0, F.min), (1, F.max))]
    base = cut(p.groupBy(tile("x").alias("tx"), tile("y").alias("ty")).agg(F.count(F.lit(1)).alias("n"), *ends))
    a, b, c, d = base.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    top = max(b - a, d - c, 1).bit_length()
    at = lambda k: [F.shiftright(F.col(n), k).alias(n) for n in ("tx", "ty")]
    level = lambda k: base.groupBy(*at(k)).agg(F.sum("n").alias("n"), *[(F.min if m[1] == "0" else F.max)(m).alias(m) for m in _BOX])
    # At the top at most two tiles each way.
    found = queries.select("id", "x", "y", "z").join(F.broadcast(level(top)), F.lit(True))
    for k in range(top, -1, -1):
        out = lambda n: F.greatest(F.col(f"{n}0") - F.col(n), F.col(n) - F.col(f"{n}1"), F.lit(0.0))
        far = lambda n: F.greatest(F.abs(F.col(n) - F.col(f"{n}0")), F.abs(F.col(n) - F.col(f"{n}1")))
        length = lambda f: F.sqrt(sum((f(n) * f(n) for n in "xyz"), F.lit(0.0)))
        d = found.withColumns({"near": length(out), "far": length(far)})
        # The query itself is one of the points.
        held = F.sum("n").over(Window.partitionBy("id").orderBy("far").rangeBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("held") > neighbours, F.col("far"))).over(Window.partitionBy("id"))
        kept = d.withColumn("held", held).withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("near") <= F.col("bound"))).select("id", "x", "y", "z", "tx", "ty")
        if k == 0:
            return cut(kept)
        parts = level(k - 1).withColumns({"px": F.shiftright("tx", 1), "py": F.shiftright("ty", 1)})
        found = cut(kept.select("id", "x", "y", "z", F.col("tx").alias("px"), F.col("ty").alias("py")).join(parts, ["px", "py"]).drop("px", "py"))
    return found


def _sparse_distances(p: DataFrame, queries: DataFrame, side: float, neighbours: int) -> DataFrame:
    """(id, mean_distance) of queries, each against the points of its own few tiles."""
    wanted = _nearest_tiles(p, queries, side, neighbours)
    held = p.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}).join(wanted.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")

    def near(asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        rows = []
        ids, at = met["id"].to_numpy(), met[["x", "y", "z"]].to_numpy()
        for q in asked.itertuples():
            far = np.sqrt(((at - (q.x, q.y, q.z)) ** 2).sum(axis=1))[ids != q.id]
            best = np.partition(far, neighbours - 1)[:neighbours] if len(far) > neighbours else far
            rows += [(q.id, float(v)) for v in best]
        return pd.DataFrame(rows, columns=["id", "far"]).astype({"id": "int64", "far": "float64"})

    best = wanted.groupBy("tx", "ty").cogroup(held.groupBy("tx", "ty")).applyInPandas(near, "id long, far double")
    # A few distances from each of a query's tiles.
    first = best.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("far")), 1, neighbours).alias("far"))
    mean = F.aggregate("far", F.lit(0.0), lambda total, v: total + v) / F.size("far")
    return queries.select("id").join(first, "id", "left").select("id", mean.alias("mean_distance"))


#: Progressive morphological filters by preset.
PMF_PRESETS = {
    "pmf_archaeology_fine": {"max_window_size": 20, "slope": 0.15, "max_distance": 0.5, "initial_distance": 0.15, "cell_size": 0.5},
    "pmf_archaeology_standard": {"max_window_size": 33, "slope": 0.25, "max_distance": 1.0, "initial_distance": 0.3, "cell_size": 1.0},
    "pmf_forested": {"max_window_size": 50, "slope": 0.5, "max_distance": 2.0, "initial_distance": 0.5, "cell_size": 2.0},
}


def minimum_grid(points: DataFrame, cellsize: float) -> DataFrame:
    """(r, c, z): the lowest point of each cell that has one."""
    return points.groupBy(F.floor(F.col("y") / cellsize).alias("r"), F.floor(F.col("x") / cellsize).cast("int").alias("c")).agg(F.min("z").alias("z"))


def _window_extreme(a: np.ndarray, half: int, f: np.ufunc, none: float) -> np.ndarray:
    """``f`` over windows of 2 half + 1 along the first axis, by running extremes of blocks as wide as the window (van Herk, Gil and Werman).

    A window meets two blocks at most: the end of one and the start of the next,
    so that a cell costs the same at any width.
    """
    n, wide = len(a), 2 * half + 1
    blocks = -(-(n + wide - 1) // wide)
    padded = np.full((blocks * wide, *a.shape[1:]), none)
    padded[half : half + n] = a
    block = padded.reshape(blocks, wide, *a.shape[1:])
    upto = f.accumulate(block, axis=1).reshape(padded.shape)
    onward = f.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(padded.shape)
    return f(onward[:n], upto[wide - 1 : wide - 1 + n])


def _opened(z: np.ndarray, half: int) -> np.ndarray:
    """The greatest of least values in windows along rows and then columns; missing cells (NaN) have no share and stay missing."""
    known, out = ~np.isnan(z), z
    for f, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
        along = np.where(known, _window_extreme(np.where(known, out, none).T, half, f, none).T, none)
        out = np.where(known, _window_extreme(along, half, f, none), np.nan)
    return out


#: Cells on the side of a tile of the morphological filter.
OPENING_TILE = 512


def _by_tiles(cells: DataFrame, halo: int, make: Callable[[np.ndarray], np.ndarray], out: str, tile: int) -> DataFrame:
    """(r, c, out): ``make`` over the array of each tile and its halo, for the cells that exist and get a value; one shuffle."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, core = (pdf[n].to_numpy() for n in ("r", "c", "is_core"))
        grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        grid[r - r.min(), c - c.min()] = pdf["z"].to_numpy()
        v = make(grid)[r - r.min(), c - c.min()]
        keep = core & ~np.isnan(v)
        return pd.DataFrame({"r": r[keep], "c": c[keep], out: v[keep]})

    given = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("int").alias("c"), F.col("z").cast("double").alias("z")).where("z IS NOT NULL")
    return haloed(given, tile, halo).groupBy("tile_r", "tile_c").applyInPandas(run, f"r long, c int, {out} double")


def opening(cells: DataFrame, half: int, value: str = "z", tile: int = OPENING_TILE) -> DataFrame:
    """Adds ``opened``: the greatest of least values in square windows, along rows and columns."""
    found = _by_tiles(cells.select("r", "c", F.col(value).alias("z")), 2 * half, lambda z: _opened(z, half), "opened", tile)
    return cells.join(found, ["r", "c"], "left")


def ground_pmf(points: DataFrame, max_window_size: int = 33, slope: float = 0.25, max_distance: float = 1.0, initial_distance: float = 0.3, cell_size: float = 1.0, base: int = 2, tile: int = OPENING_TILE) -> DataFrame:
    """The points that a progressive morphological filter takes for ground (Zhang et al. 2003).

    Windows grow as powers of the base; a cell whose opening lies more than the
    threshold below it stops counting as ground.  All rounds of a tile run at once:
    its halo is as wide as all windows together can reach.
    """
    steps, half, before = [], 1, 0
    while 2 * half + 1 <= max_window_size:
        steps.append((half, initial_distance if not steps else min(max_distance, slope * 2 * (half - before) * cell_size + initial_distance)))
        before, half = half, max(half + 1, half * base)

    def filtered(z: np.ndarray) -> np.ndarray:
        ground = np.ones(z.shape, bool)
        for half, limit in steps:
            opened = _opened(z, half)
            ground &= z - opened <= limit
            z = opened
        return np.where(ground, z, np.nan)

    surface = _by_tiles(minimum_grid(points, cell_size), 2 * sum(half for half, _ in steps), filtered, "s", tile)
    p = points.withColumns({"r": F.floor(F.col("y") / cell_size), "c": F.floor(F.col("x") / cell_size).cast("int")})
    return p.join(surface, ["r", "c"]).where(F.col("z") - F.col("s") <= max_distance).drop("r", "c", "s")


#: Cloth filters by preset.
CLOTH_PRESETS = {
    "archaeology_fine": {"cloth_resolution": 0.5, "class_threshold": 0.5, "rigidness": 1, "time_step": 0.65, "slope_smooth": False},
    "archaeology_standard": {"cloth_resolution": 1.0, "class_threshold": 0.8, "rigidness": 2, "time_step": 0.65, "slope_smooth": True},
    "forested": {"cloth_resolution": 2.0, "class_threshold": 1.2, "rigidness": 3, "time_step": 0.50, "slope_smooth": True},
    "urban": {"cloth_resolution": 1.0, "class_threshold": 0.5, "rigidness": 1, "time_step": 0.65, "slope_smooth": True},
}


def ground_cloth(points: DataFrame, cloth_resolution: float = 1.0, class_threshold: float = 0.8, rigidness: int = 2, time_step: float = 0.65, slope_smooth: bool = True, tile: int = cloth.TILE) -> DataFrame:
    """The points near a cloth draped over the inverted cloud; see :mod:`tellurian.operators.cloth`.

    A node lies over the lowest of its points.  Any ``tile`` (nodes on a side) gives
    the same points; without threads or seeds, so reruns agree.  No parity with
    other implementations is claimed.  Points without coordinates are left out.
    """
    place = lambda n: F.floor(F.col(n) / cloth_resolution)
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").withColumns({"__r": place("y"), "__c": place("x")})
    nodes = cut(p.groupBy(F.col("__r").alias("r"), F.col("__c").alias("c")).agg((-F.min("z")).alias("h")))
    ground = cloth.draped(nodes, rigidness, time_step, slope_smooth, tile).select(F.col("r").alias("__r"), F.col("c").alias("__c"), (-F.col("cloth")).alias("__ground"))
    return p.join(ground, ["__r", "__c"]).where(F.abs(F.col("z") - F.col("__ground")) <= class_threshold).select(*points.columns)


#: Classification codes of ordinary points and of ground.
UNCLASSIFIED, GROUND = 1, 2


def by_class(points: DataFrame, keep: int = GROUND) -> DataFrame:
    """Points of one classification code."""
    return points.where(F.col("classification") == keep)


def without_outliers(points: DataFrame, bucket: float, neighbours: int = 8, multiplier: float = 2.0) -> DataFrame:
    """The points that are no statistical outliers, as ordinary points of code 1."""
    kept = outliers(points, bucket, neighbours, multiplier).where("NOT is_outlier").select("id")
    return points.join(kept, "id", "left_semi").withColumn("classification", F.lit(UNCLASSIFIED))


#: A surface is not made from fewer ground points.
LEAST_POINTS = 10


def ground_surface(points: DataFrame, cellsize: float, ground: str = "pmf_archaeology_standard", radius: float | None = None) -> DataFrame:
    """(r, c, z): ground points by a preset of either filter (or ``classified``, by their code), gridded."""
    if ground in PMF_PRESETS:
        kept = ground_pmf(points, **PMF_PRESETS[ground])
    elif ground in CLOTH_PRESETS:
        kept = ground_cloth(points, **CLOTH_PRESETS[ground])
    elif ground == "classified":
        kept = by_class(points)
    else:
        raise ValueError(f"Unknown ground filter: {ground}")
    kept = cut(kept.select("x", "y", "z"))
    if (n := kept.limit(LEAST_POINTS).count()) < LEAST_POINTS:
        raise ValueError(f"{n} ground points are too few for a surface; {LEAST_POINTS} are needed")
    return grid_idw(kept, cellsize, radius)
