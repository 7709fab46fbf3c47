"""Registry of the terrain queries and their SQL counterparts.

Every query runs an operator over its whole surface and rounds to six decimals
(or gives integers); the SQL restates the operator for DuckDB over the same
surface definition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.functions import records, scale, text
from tellurian.operators import blend, change, detect, grid, horizon, inference, points, project, stencil
from tellurian.operators.lineage import reserve
from tellurian.plans import oracles as o
from tellurian.sources import files, geotiff
from tellurian.sources import surfaces as s

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds the named columns (all doubles without names), negative zero as zero."""
    cols = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in cols})


# --- sources, tiles, nodata ---------------------------------------------------------------------


@query(s.ctes("dem") + " SELECT r, c, round(z, 6) AS z FROM dem")
def read_dem(spark, d):
    path = reserve(spark, "cells")
    files.write_cells(s.dem_dense(spark, d), path, tile=256)
    return rounded(files.read_cells(spark, path))


@query(s.ctes("sparse") + " SELECT r, c, round(coalesce(z, -9999.0::DOUBLE), 6) AS z FROM sparse")
def write_nodata(spark, d):
    path = reserve(spark, "cells")
    files.write_cells(s.dem_sparse(spark, d), path, tile=256, nodata=grid.NODATA)
    return rounded(files.read_cells(spark, path))  # the tag as it stands in the file


@query(s.ctes("sparse") + " SELECT r, c, round(CASE WHEN isnan(t) OR abs(t + 9999) <= 1e-5 THEN NULL ELSE t END, 6) AS z FROM (SELECT r, c, coalesce(z, -9999.0::DOUBLE) AS t FROM sparse)")
def match_nodata(spark, d):
    return rounded(grid.from_nodata(grid.to_nodata(s.dem_sparse(spark, d))))


@query(s.ctes("dem") + " SELECT r // 128 AS tile_r, (c // 32)::BIGINT AS tile_c, count(*) AS n, round(sum(z), 4) AS total FROM dem GROUP BY ALL")
def tile_windows(spark, d):
    t = grid.tiles(s.dem_dense(spark, d), 128).withColumn("tile_c", F.floor(F.col("c") / 32))
    return t.groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("total"))


@query(s.ctes("dem") + """ SELECT tr AS tile_r, tc AS tile_c, count(*) AS cells, count(*) FILTER (r // 64 = tr AND c // 64 = tc) AS core
    FROM dem, LATERAL (SELECT unnest(range(floor((r - 10) / 64)::BIGINT, floor((r + 10) / 64)::BIGINT + 1)) AS tr), LATERAL (SELECT unnest(range(floor((c - 10) / 64)::BIGINT, floor((c + 10) / 64)::BIGINT + 1)) AS tc)
    GROUP BY ALL""")
def haloed_tiles(spark, d):
    h = grid.haloed(s.dem_dense(spark, d), 64, 10)
    return h.groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("cells"), F.count_if("is_core").alias("core"))


@query(s.ctes("dem") + """, g AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM dem), k AS (SELECT *, greatest(1.0::DOUBLE, greatest(rows, cols)::DOUBLE / 100) AS k FROM g),
    m AS (SELECT rows, cols, greatest(1, trunc(rows / k)::BIGINT) AS pr, greatest(1, trunc(cols / k)::BIGINT) AS pc FROM k)
    SELECT i.range AS r, j.range::INT AS c, round(z, 6) AS z FROM m, range(m.pr) i, range(m.pc) j, dem
    WHERE dem.r = floor((i.range + 0.5::DOUBLE) * rows / pr) AND dem.c = floor((j.range + 0.5::DOUBLE) * cols / pc)""")
def decimated_read(spark, d):
    return rounded(grid.downsample(s.dem_dense(spark, d), 100))


@query(s.ctes("sparse") + " SELECT max(r) + 1 AS rows, max(c) + 1 AS cols, count(z) AS valid, round(min(z), 6) AS min, round(max(z), 6) AS max FROM sparse")
def describe_raster(spark, d):
    c = s.dem_sparse(spark, d)
    return rounded(c.agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count("z").alias("valid"), F.min("z").alias("min"), F.max("z").alias("max")))


# --- stencils and windows -----------------------------------------------------------------------


@query(o.gradient("dem", "round(degrees(atan(steep)), 6) AS slope"))
def slope_degrees(spark, d):
    return rounded(stencil.slope(s.dem_dense(spark, d), s.CELL))


@query(o.gradient("dem", "round(steep * 100.0::DOUBLE, 6) AS slope"))
def slope_percent(spark, d):
    return rounded(stencil.slope(s.dem_dense(spark, d), s.CELL, "percent"))


@query(o.gradient("dem", "round(degrees(atan(steep)), 6) AS slope", central=True))
def slope_central(spark, d):
    return rounded(stencil.slope(s.dem_dense(spark, d), s.CELL, method="central"))


@query(o.gradient("sparse", "round(degrees(atan(steep)), 6) AS slope"))
def slope_sparse(spark, d):
    return rounded(stencil.slope(s.dem_sparse(spark, d), s.CELL))


@query(o.gradient("dem", f"round({o.shade(315, 45)}, 6) AS shade"))
def hillshade_single(spark, d):
    return rounded(stencil.gradients(s.dem_dense(spark, d), s.CELL).select("r", "c", stencil.shade_of(315, 45).alias("shade")))


@query(o.gradient("dem", f"round(({' + '.join(o.shade(a, 45) for a in stencil.DEFAULT_AZIMUTHS)}) / 6 * 255.0::DOUBLE, 6) AS hillshade"))
def hillshade_multi(spark, d):
    return rounded(stencil.hillshade(s.dem_dense(spark, d), s.CELL))


@query("SELECT r, c, band, round(v, 6) AS v FROM (" + " UNION ALL ".join(f"SELECT r, c, {k}::INT AS band, v FROM ({o.gradient('sparse', o.shade(360.0 * k / 16, 45) + ' AS v')}) WHERE v IS NOT NULL" for k in range(16)) + ")")
def hillshade_bands(spark, d):
    return rounded(stencil.hillshade_bands(s.dem_sparse(spark, d), s.CELL))


@query(o.RUGGEDNESS)
def ruggedness(spark, d):
    return rounded(stencil.ruggedness(s.dem_sparse(spark, d)))


@query(o.local_relief("dem", 20))
def local_relief(spark, d):
    return rounded(stencil.local_relief(s.dem_dense(spark, d), 20))


@query(o.local_relief("sparse", 5))
def local_relief_sparse(spark, d):
    return rounded(stencil.local_relief(s.dem_sparse(spark, d), 5))


@query(s.ctes("dem") + """ SELECT r, c, round(sum(s1) OVER v, 4) AS sum_z, round(sum(s2) OVER v, 2) AS sum_sq FROM
    (SELECT r, c, sum(z) OVER h AS s1, sum(z * z) OVER h AS s2 FROM dem WINDOW h AS (PARTITION BY r ORDER BY c)) WINDOW v AS (PARTITION BY c ORDER BY r)""")
def integral_image(spark, d):
    i = stencil.integral_image(s.dem_dense(spark, d))
    return i.select("r", "c", F.round("sum_z", 4).alias("sum_z"), F.round("sum_sq", 2).alias("sum_sq"))


@query(o.deviation("dem", 5))
def window_deviation(spark, d):
    return rounded(stencil.deviation(s.dem_dense(spark, d), 5, "dev"), digits=5)


@query(o.mstp("dem", 5, 50, 500))
def mstp(spark, d):
    return stencil.mstp(s.dem_dense(spark, d))


@query(o.mstp("sparse", 3, 10, 40))
def mstp_sparse(spark, d):
    return stencil.mstp(s.dem_sparse(spark, d), 3, 10, 40)


# --- horizons -----------------------------------------------------------------------------------


@query(f"SELECT k::INT AS k, dr::INT AS dr, dc::INT AS dc, round(dist, 9) AS dist FROM ({o.ray_samples(16, 10)})")
def ray_geometry(spark, d):
    return horizon.ray_table(spark, 16, 10).withColumn("dist", F.round("dist", 9))


@query(o.sky_view("dem", 16, 10))
def sky_view_factor(spark, d):
    return rounded(horizon.sky_view_factor(s.dem_dense(spark, d), s.CELL))


@query(o.sky_view("dem", 8, 5))
def sky_view_by_join(spark, d):
    return rounded(horizon.svf_by_join(s.dem_dense(spark, d), s.CELL, 8, 5))


@query(o.sky_view("sparse", 16, 10))
def sky_view_sparse(spark, d):
    return rounded(horizon.sky_view_factor(s.dem_sparse(spark, d), s.CELL))


@query(o.sky_view_noise("dem", 16, 10, 2))
def sky_view_noise(spark, d):
    return rounded(horizon.sky_view_factor(s.dem_dense(spark, d), s.CELL, noise=2))


@query(o.anisotropic_noise("dem", 16, 10, 315.0, 0.5, 3))
def anisotropic_noise(spark, d):
    return rounded(horizon.anisotropic_sky_view(s.dem_dense(spark, d), s.CELL, noise=3))


@query(o.anisotropic("dem", 16, 10, 315.0, 0.5))
def anisotropic_sky_view(spark, d):
    return rounded(horizon.anisotropic_sky_view(s.dem_dense(spark, d), s.CELL))


@query(o.openness("dem", 16, 10, False))
def openness_positive(spark, d):
    return rounded(horizon.openness(s.dem_dense(spark, d), s.CELL))


@query(o.openness("dem", 16, 10, True))
def openness_negative(spark, d):
    return rounded(horizon.openness(s.dem_dense(spark, d), s.CELL, negative=True))


@query(o.dominance("dem", 10.0, 20.0, 1.0, 15.0, 1.7))
def local_dominance(spark, d):
    return rounded(horizon.local_dominance(s.dem_dense(spark, d), s.CELL))


@query(o.dominance("sparse", 2.0, 5.0, 1.0, 45.0, 1.7))
def local_dominance_sparse(spark, d):
    return rounded(horizon.local_dominance(s.dem_sparse(spark, d), s.CELL, 2.0, 5.0, 1.0, 45.0))


# --- blends and composites ----------------------------------------------------------------------


def _pair(spark, d):
    z = F.col("z")
    return s.dem_new(spark, d).select("r", "c", (z * 3 + 128).alias("a"), F.when((F.col("r") + F.col("c")) % 17 != 0, 255 - F.abs(z) * 4).alias("b"))


for _mode in blend.MODES:
    query(o.blend_pair(_mode, 0.75), name=f"blend_{_mode}")(lambda spark, d, m=_mode: rounded(_pair(spark, d).select("r", "c", blend.blend(F.col("a"), F.col("b"), m, 0.75).alias("v"))))


@query(s.ctes("dem") + """, e AS (SELECT min(z) AS low, max(z) AS high FROM dem) SELECT r, c, round(z / 100, 6) AS a, round((z - low) / (high - low) * 255.0::DOUBLE, 6) AS b FROM dem, e""")
def blend_inputs(spark, d):
    return rounded(blend.scaled_inputs(s.dem_dense(spark, d).select("r", "c", (F.col("z") / 100).alias("a"), F.col("z").alias("b"))))


@query(s.ctes("sparse") + """, e AS (SELECT min(z) AS low, max(z) AS high FROM sparse) SELECT r, c, round((1 - (z - low) / (high - low)) * 255.0::DOUBLE, 6) AS v FROM sparse, e""")
def normalise_inverted(spark, d):
    c = s.dem_sparse(spark, d)
    low, high = blend.extremes(c, "z")["z"]
    return rounded(c.select("r", "c", ((1.0 - blend.unit_range(F.col("z"), low, high)) * 255.0).alias("v")))


@query(s.ctes("sparse") + """, e AS (SELECT quantile_cont(z, 0.02::DOUBLE) AS a, quantile_cont(z, 0.98::DOUBLE) AS b FROM sparse)
    SELECT r, c, CASE WHEN z IS NULL THEN 24 ELSE trunc(greatest(least((z - a) / (b - a), 1), 0) * 255.0::DOUBLE)::INT END AS byte FROM sparse, e""")
def percentile_stretch(spark, d):
    return blend.percentile_stretch(s.dem_sparse(spark, d), "z")


@query(s.ctes("dem") + " SELECT round(greatest(min(z), avg(z) - 2 * stddev_pop(z)), 6) AS low, round(least(max(z), avg(z) + 2 * stddev_pop(z)), 6) AS high FROM dem")
def deviation_stretch(spark, d):
    return rounded(spark.createDataFrame([blend.deviation_stretch(s.dem_dense(spark, d), "z")], "low double, high double"))


@query(s.ctes("dem", "dem_new") + """ SELECT coalesce(n.r, d.r) AS r, coalesce(n.c, d.c) AS c, round(coalesce(n.z, d.z), 6) AS z FROM dem d FULL JOIN dem_new n ON n.r = d.r AND n.c = d.c""")
def mosaic(spark, d):
    return rounded(blend.mosaic(s.dem_dense(spark, d), s.dem_new(spark, d)))


@query(s.ctes("dem", "dem_new") + " SELECT d.r, d.c, round(d.z, 6) AS before, round(n.z, 6) AS after FROM dem d JOIN dem_new n ON n.r = d.r AND n.c = d.c")
def band_stack(spark, d):
    tag = lambda df, n: df.select("r", "c", F.lit(n).alias("band"), F.col("z").alias("v"))
    long = tag(s.dem_dense(spark, d), "before").unionByName(tag(s.dem_new(spark, d), "after"))
    return rounded(blend.stacked(long, ["before", "after"]))


@query(o.vat("dem", 50, 50))
def vat(spark, d):
    return rounded(blend.vat(s.dem_dense(spark, d), s.CELL), digits=4)


@query(o.red_relief("dem", 20))
def red_relief(spark, d):
    return rounded(blend.red_relief(s.dem_dense(spark, d), s.CELL, 20))


@query(o.e4mstp("dem"))
def e4mstp(spark, d):
    return blend.e4mstp_of(s.dem_dense(spark, d), s.CELL)


_LAYER_SQL = {
    "slope": o.gradient("dem", "round(degrees(atan(steep)), 6) AS slope"), "hillshade": o.gradient("dem", f"round(({' + '.join(o.shade(a, 45) for a in stencil.DEFAULT_AZIMUTHS)}) / 6 * 255.0::DOUBLE, 6) AS hillshade"),
    "slrm": o.local_relief("dem", 20), "svf": o.sky_view("dem", 16, 10), "asvf": o.anisotropic("dem", 16, 10, 315.0, 0.5), "openness": o.openness("dem", 16, 10, False), "local_dominance": o.dominance("dem", 10.0, 20.0, 1.0, 15.0, 1.7),
}


def _bands(sql: str, name: str) -> str:
    return f"SELECT r, c, red AS {name}_red, green AS {name}_green, blue AS {name}_blue FROM ({sql})"


@query(o.joined(*_LAYER_SQL.values(), _bands(o.mstp("dem", 5, 50, 500), "mstp"), o.vat("dem", 50, 50), o.red_relief("dem", 20), _bands(o.e4mstp("dem"), "e4mstp")))
def batch_run(spark, d):
    """All products but the components, which SQL cannot express; a test compares all twelve with the operators alone."""
    found = blend.batch(s.dem_dense(spark, d), s.CELL, tuple(n for n in blend.BATCH if n != "pca"))
    return rounded(rounded(found, "vat", digits=4))


_PCA = ("svf", "opn", "slope", "ld")
_STD = {n: f"(SELECT stddev_pop({n}) FROM l)" for n in _PCA}


@query("WITH l AS (SELECT r, c, svf, openness AS opn, slope, local_dominance AS ld FROM (" + o.joined(*[_LAYER_SQL[n] for n in ("svf", "openness", "slope", "local_dominance")]) + ")) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round((SELECT covar_samp({a}, {b}) FROM l) / {_STD[a]} / {_STD[b]}, 5) AS covariance" for a in _PCA for b in _PCA))
def pca_covariance(spark, d):
    found = blend.moments(rounded(blend.pca_layers(s.dem_dense(spark, d), s.CELL)), _PCA)
    return rounded(spark.createDataFrame([(a, b, float(found[2][i, j])) for i, a in enumerate(_PCA) for j, b in enumerate(_PCA)], "a string, b string, covariance double"), digits=5)


@query()
def pca_composite(spark, d):
    return rounded(blend.pca_of(s.dem_dense(spark, d), s.CELL), digits=4)


@query(s.ctes("dem", "dem_new") + """ SELECT round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std,
    round(quantile_cont(z, 0.05::DOUBLE), 6) AS p5, round(quantile_cont(z, 0.25::DOUBLE), 6) AS p25, round(quantile_cont(z, 0.5::DOUBLE), 6) AS p50, round(quantile_cont(z, 0.75::DOUBLE), 6) AS p75,
    round(quantile_cont(z, 0.95::DOUBLE), 6) AS p95, count(z) AS valid, count(*) - count(z) AS nodata FROM dem_new""")
def report_statistics(spark, d):
    return rounded(blend.report_statistics(s.dem_new(spark, d)))


@query(s.ctes("dem") + ", e AS (SELECT min(z) AS low, max(z) AS high FROM dem) SELECT least(floor((z - low) / ((high - low) / 100)), 99)::INT AS bin, count(*) AS n FROM dem, e GROUP BY ALL")
def histogram(spark, d):
    return blend.histogram(s.dem_dense(spark, d))


@query(s.ctes("dem") + """, l1 AS (SELECT r // 2 AS r, c // 2 AS c, avg(z) AS z FROM dem GROUP BY ALL), l2 AS (SELECT r // 2 AS r, c // 2 AS c, avg(z) AS z FROM l1 GROUP BY ALL)
    SELECT 0 AS level, r, c::INT AS c, round(z, 6) AS z FROM dem UNION ALL SELECT 1, r, c::INT, round(z, 6) FROM l1 UNION ALL SELECT 2, r, c::INT, round(z, 6) FROM l2""")
def pyramid(spark, d):
    return rounded(blend.pyramid(s.dem_dense(spark, d), 2))


@query(s.ctes("dem_new") + " SELECT r, c, round(z, 6) AS z FROM dem_new WHERE r >= 10 AND c BETWEEN 5 AND 60")
def geotiff_window(spark, d):
    """A surface written as sheets of tiles and a window read back: rows and columns reach the tile index."""
    path = reserve(spark, "geotiff")
    geotiff.write_geotiff(s.dem_new(spark, d), path, sheet=128, tile=16, overviews=2)
    return rounded(geotiff.read_geotiff(spark, path).where("r >= 10 AND c BETWEEN 5 AND 60"))


@query(s.ctes("dem_new") + " SELECT r // 2 AS r, (c // 2)::INT AS c, round(avg(z), 6) AS z FROM dem_new GROUP BY ALL")
def geotiff_overview(spark, d):
    path = reserve(spark, "geotiff")
    geotiff.write_geotiff(s.dem_new(spark, d), path, sheet=128, tile=16, overviews=2)
    rows = s.dem_new(spark, d).agg(F.max("r")).first()[0] // 2
    return rounded(geotiff.read_geotiff(spark, path, level=1).where(F.col("r") <= rows))


# --- change, resampling, fusion -----------------------------------------------------------------

_LIMIT = change.detection_limit()
_DOD = f""", d AS (SELECT a.r, a.c, b.z - a.z AS dod FROM dem a LEFT JOIN dem_new b ON a.r = b.r AND a.c = b.c),
    m AS (SELECT *, CASE WHEN dod IS NULL THEN 255 WHEN dod < -{_LIMIT!r}::DOUBLE THEN 1 WHEN dod > {_LIMIT!r}::DOUBLE THEN 2 ELSE 0 END AS mask FROM d)"""


@query(s.ctes("dem", "dem_new") + _DOD + " SELECT r, c, round(dod, 6) AS dod, mask FROM m")
def dem_difference(spark, d):
    return rounded(change.difference(s.dem_dense(spark, d), s.dem_new(spark, d), _LIMIT))


@query(s.ctes("dem", "dem_new") + _DOD + f""" SELECT count(dod) AS total_cells, count(*) FILTER (mask IN (1, 2)) AS significant, count(*) FILTER (mask = 1) AS cut_cells, count(*) FILTER (mask = 2) AS fill_cells,
    round(sum(-dod) FILTER (mask = 1) * 0.25::DOUBLE, 3) AS cut_volume, round(sum(dod) FILTER (mask = 2) * 0.25::DOUBLE, 3) AS fill_volume,
    round(sum(dod) FILTER (mask IN (1, 2)) * 0.25::DOUBLE, 3) AS net_volume, round(min(dod), 3) AS min, round(max(dod), 3) AS max, round(avg(dod), 3) AS mean, round({_LIMIT!r}::DOUBLE, 3) AS threshold FROM m""")
def difference_report(spark, d):
    return rounded(change.difference_report(change.difference(s.dem_dense(spark, d), s.dem_new(spark, d), _LIMIT), 0.25, _LIMIT), digits=3)


@query(s.ctes("bands") + ", g AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM bands) SELECT i.range AS r, j.range::INT AS c, round(b4, 6) AS z FROM g, range(2 * g.rows) i, range(2 * g.cols) j, bands b WHERE b.r = i.range // 2 AND b.c = j.range // 2")
def resample_nearest(spark, d):
    b = s.bands(spark, d).select("r", "c", F.col("b4").alias("z"))
    g = grid.grid_stats(b)
    return rounded(change.resample_nearest(b, 2.0, 2 * (g.last_r + 1), 2 * (g.last_c + 1)))


@query(s.ctes("bands") + """, g AS (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM bands),
    t AS (SELECT i.range AS r, j.range::INT AS c, (i.range + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS y, (j.range + 0.5::DOUBLE) / 2 - 0.5::DOUBLE AS x, rows, cols FROM g, range(2 * g.rows) i, range(2 * g.cols) j),
    k AS (SELECT r, c, greatest(least(floor(y) + a, rows - 1), 0)::BIGINT AS sr, greatest(least(floor(x) + b, cols - 1), 0)::BIGINT AS sc,
        (CASE a WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE b WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM t, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b))
    SELECT k.r, k.c, round(sum(w * b4), 6) AS z FROM k JOIN bands s ON s.r = k.sr AND s.c = k.sc GROUP BY k.r, k.c""")
def resample_bilinear(spark, d):
    b = s.bands(spark, d).select("r", "c", F.col("b4").alias("z"))
    g = grid.grid_stats(b)
    return rounded(change.resample_bilinear(b, 2.0, 2 * (g.last_r + 1), 2 * (g.last_c + 1), g.last_r, g.last_c))


_HOW = {"average": "avg(z)", "min": "min(z)", "max": "max(z)", "sum": "sum(z)", "median": "median(z)", "q1": "quantile_cont(z, 0.25::DOUBLE)", "q3": "quantile_cont(z, 0.75::DOUBLE)", "rms": "sqrt(avg(z * z))"}
for _how, _sql in _HOW.items():
    query(s.ctes("dem") + f" SELECT r // 4 AS r, (c // 4)::INT AS c, round({_sql}, 4) AS z FROM dem GROUP BY ALL", name=f"resample_{_how}")(
        lambda spark, d, h=_how: rounded(change.resample_aggregate(s.dem_dense(spark, d), 4, h), digits=4)
    )


@query(s.ctes("labels_at") + """, n AS (SELECT r // 4 AS r, (c // 4)::INT AS c, label, count(*) AS n FROM labels_at GROUP BY ALL)
    SELECT r, c, z FROM (SELECT r, c, label AS z, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, label) AS nth FROM n) WHERE nth = 1""")
def resample_mode(spark, d):
    return change.resample_aggregate(s.label_grid(spark, d).select("r", "c", F.col("label").alias("z")), 4, "mode")


_HALF = "2 * rows AS rows, 2 * cols AS cols"
for _kind in ("cubic", "cubic_spline", "lanczos"):

    def _finer(spark, d, kind=_kind):
        b = s.band_dem(spark, d)
        g = grid.grid_stats(b)
        return rounded(change.resample(b, kind, 2 * (g.last_r + 1), 2 * (g.last_c + 1), (0.5, -0.25), (0.5, -0.25)))

    query(o.resampled("band_dem", "z", _kind, 0.5, -0.25, _HALF), name=f"resample_{_kind}")(_finer)


@query(o.REPROJECT_POINTS)
def reproject_points(spark, d):
    """Points of one zone of six degrees in degrees and in the next zone."""
    there = s.cloud(spark, d).select("id", (714_900 + F.col("x") * 400).alias("x"), (5_546_000 - F.col("y") * 400).alias("y"))
    degrees = project.reproject(there, "EPSG:32631", "EPSG:4326", out=("lon", "lat"))
    moved = project.reproject(degrees, "EPSG:4326", "EPSG:32632", "lon", "lat", ("x", "y"))
    return rounded(rounded(moved, "lon", "lat", digits=7), "x", "y", digits=2)


#: A grid in one zone, and one in the next whose cells are wider and turned by four and a half degrees against it.
_ZONE_OLD, _ZONE_NEW = (714_900.0, 10.0, 5_546_000.0, -10.0), (284_700.0, 16.0, 5_546_250.0, -12.0)


@query(o.reprojected_difference(_ZONE_OLD, _ZONE_NEW, _LIMIT))
def reprojected_difference(spark, d):
    """Two surfaces in two zones; a nanometre moves the sixth decimal of so rough a surface, so that two are compared."""
    return rounded(change.difference_on_grid(s.dem_dense(spark, d), s.dem_new(spark, d), _ZONE_OLD, _ZONE_NEW, _LIMIT, "bilinear", "EPSG:32631", "EPSG:32632"), digits=2)


_SOURCE, _TARGET = (0.0, 1.0, 0.0, -1.0), (0.3, 1.7, -0.3, -1.7)


@query(o.resampled("sparse", "z", "bilinear", *change.axis_map(*_SOURCE[:2], *_TARGET[:2]), "floor(rows / 1.7::DOUBLE)::BIGINT AS rows, floor(cols / 1.7::DOUBLE)::BIGINT AS cols"))
def match_grid(spark, d):
    """Another grid, of wider cells and with its corner elsewhere: no whole factor leads there."""
    c = s.dem_sparse(spark, d)
    g = grid.grid_stats(c)
    return rounded(change.match_grid(c, _SOURCE, _TARGET, int((g.last_r + 1) / 1.7), int((g.last_c + 1) / 1.7)))


@query("""SELECT s_suppkey AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'coordinate systems differ: EPSG:27700, EPSG:4326' WHEN s_nationkey % 3 = 0 THEN 'extents differ' END AS misalignment FROM supplier""")
def raster_alignment(spark, d):
    k = F.col("s_nationkey")
    box = lambda dx: F.struct(F.lit(0.0).alias("x_min"), F.lit(0.0).alias("y_min"), (F.lit(100.0) + dx).alias("x_max"), F.lit(50.0).alias("y_max"))
    found = change.misalignment(F.lit("EPSG:27700"), F.when(k % 5 == 0, "EPSG:4326").when(k % 7 != 0, "EPSG:27700"), box(F.lit(0.0)), box(F.when(k % 3 == 0, 0.5).otherwise(1e-5)))
    return s.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), found.alias("misalignment"))


for _recipe, (_layer, _bands, _m, _op) in change.FUSION_RECIPES.items():
    query(o.fusion(_layer, tuple(b.lower() for b in _bands), _m, _op), name=f"fusion_{_recipe}")(
        lambda spark, d, recipe=_recipe: change.fusion(s.band_dem(spark, d), s.spectral(spark, d), recipe, s.CELL)
    )


@query("SELECT * FROM (VALUES " + ", ".join(repr(b) for b in change.SPECTRAL_BANDS) + ") t(band, description, resolution, centre_nm)")
def spectral_bands(spark, d):
    return spark.createDataFrame(change.SPECTRAL_BANDS, "band string, description string, resolution int, centre_nm int")


# --- points -------------------------------------------------------------------------------------


@query(o.IDW)
def points_to_dem(spark, d):
    return rounded(points.grid_idw(s.cloud(spark, d), 2.0), digits=5)


@query(o.OUTLIERS)
def point_outliers(spark, d):
    return rounded(points.outliers(s.cloud(spark, d), 4.0))


@query(s.ctes("cloud") + " SELECT floor(y)::BIGINT AS r, floor(x)::INT AS c, round(min(z), 6) AS z FROM cloud GROUP BY ALL")
def minimum_grid(spark, d):
    return rounded(points.minimum_grid(s.cloud(spark, d), 1.0))


@query(o.OPENING)
def morphological_opening(spark, d):
    return rounded(points.opening(points.minimum_grid(s.cloud(spark, d), 1.0), 2).select("r", "c", "opened"))


@query(o.pmf())
def ground_pmf(spark, d):
    return points.ground_pmf(s.cloud(spark, d), **points.PMF_PRESETS["pmf_archaeology_standard"]).select("id")


@query(o.ground_grid())
def ground_surface(spark, d):
    return rounded(points.ground_surface(s.cloud(spark, d), 2.0), digits=5)


@query()
def ground_cloth(spark, d):
    return points.ground_cloth(s.cloud(spark, d), **points.CLOTH_PRESETS["archaeology_standard"]).select("id")


@query(s.ctes("cloud") + " SELECT id FROM (SELECT id, CASE WHEN z > 150 THEN 7 WHEN id % 4 = 0 THEN 5 ELSE 2 END AS classification FROM cloud) WHERE classification = 2")
def class_filter(spark, d):
    c = s.cloud(spark, d).withColumn("classification", F.when(F.col("z") > 150, 7).when(F.col("id") % 4 == 0, 5).otherwise(2))
    return points.by_class(c).select("id")


# --- detections and segments --------------------------------------------------------------------

_LABELS = ["barrow", "bank"]


@query(s.ctes("boxes") + """, p AS (SELECT id, x1, y1, x2, y2, confidence, class_id, (id % 4 * 160)::INT AS off_x, (id % 3 * 160)::INT AS off_y FROM boxes),
    q AS (SELECT id, class_id, round(confidence, 4) AS confidence, round(greatest(least(x1 * 160.0::DOUBLE / 200 + off_x, off_x + 160), off_x), 2) AS x1, round(greatest(least(y1 * 160.0::DOUBLE / 200 + off_y, off_y + 160), off_y), 2) AS y1,
        round(greatest(least(x2 * 160.0::DOUBLE / 200 + off_x, off_x + 160), off_x), 2) AS x2, round(greatest(least(y2 * 160.0::DOUBLE / 200 + off_y, off_y + 160), off_y), 2) AS y2 FROM p WHERE confidence >= 0.25)
    SELECT *, CASE class_id WHEN 0 THEN 'barrow' WHEN 1 THEN 'bank' ELSE 'class_2' END AS class_name FROM q WHERE x2 > x1 AND y2 > y1""")
def decode_boxes(spark, d):
    raw = s.boxes(spark, d).withColumns({"off_x": (F.col("id") % 4 * 160).cast("int"), "off_y": (F.col("id") % 3 * 160).cast("int"), "tile_w": F.lit(160), "tile_h": F.lit(160)})
    return detect.decode_boxes(raw, 0.25, (200, 200), _LABELS)


@query(s.ctes("boxes") + """ SELECT id, class_id, round(k, 6) AS confidence, round(x1 - 2, 6) AS x1, round(y1 - 3, 6) AS y1, round(x1 + 2, 6) AS x2, round(y1 + 3, 6) AS y2 FROM (
    SELECT id, x1, y1, confidence * greatest(0.2::DOUBLE, (id % 10) / 10.0::DOUBLE, (id % 7) / 7.0::DOUBLE) AS k,
    CASE WHEN 0.2::DOUBLE >= greatest((id % 10) / 10.0::DOUBLE, (id % 7) / 7.0::DOUBLE) THEN 0 WHEN (id % 10) / 10.0::DOUBLE >= (id % 7) / 7.0::DOUBLE THEN 1 ELSE 2 END AS class_id FROM boxes)""")
def decode_centres(spark, d):
    k = F.col("id")
    raw = s.boxes(spark, d).select("id", F.col("x1").alias("cx"), F.col("y1").alias("cy"), F.lit(4.0).alias("w"), F.lit(6.0).alias("h"), F.col("confidence").alias("objectness"), F.array(F.lit(0.2), k % 10 / 10.0, k % 7 / 7.0).alias("scores"))
    return rounded(detect.decode_centres(raw))


@query(o.SUPPRESSION)
def suppress_boxes(spark, d):
    return detect.suppress(s.boxes(spark, d).where("confidence >= 0.5"), 0.45).select("id", "class_id")


@query(s.ctes("boxes") + """ SELECT id, round(400000 + x1 * 0.5::DOUBLE, 6) AS min_x, round(300000 - y2 * 0.5::DOUBLE, 6) AS min_y, round(400000 + x2 * 0.5::DOUBLE, 6) AS max_x, round(300000 - y1 * 0.5::DOUBLE, 6) AS max_y,
    printf('POLYGON ((%.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f, %.3f %.3f))', 400000 + x1 * 0.5::DOUBLE, 300000 - y2 * 0.5::DOUBLE, 400000 + x2 * 0.5::DOUBLE, 300000 - y2 * 0.5::DOUBLE, 400000 + x2 * 0.5::DOUBLE, 300000 - y1 * 0.5::DOUBLE,
        400000 + x1 * 0.5::DOUBLE, 300000 - y1 * 0.5::DOUBLE, 400000 + x1 * 0.5::DOUBLE, 300000 - y2 * 0.5::DOUBLE) AS wkt FROM boxes""")
def map_boxes(spark, d):
    return rounded(detect.map_boxes(s.boxes(spark, d), (400000.0, 0.5, 0.0, 300000.0, 0.0, -0.5)).select("id", "min_x", "min_y", "max_x", "max_y", "wkt"))


@query(s.ctes("dem") + """, e AS (SELECT r, c, z / 20 AS b, exp(-greatest(0, z / 20, -z / 30)) AS k, z FROM dem), p AS (SELECT r, c, exp(0 - greatest(0, b, -z / 30)) AS p0, exp(b - greatest(0, b, -z / 30)) AS p1, exp(-z / 30 - greatest(0, b, -z / 30)) AS p2, b, z FROM e),
    t AS (SELECT r, c, 1 / (p0 + p1 + p2) AS best, CASE WHEN 0 >= greatest(b, -z / 30) THEN 0 WHEN b >= -z / 30 THEN 1 ELSE 2 END AS hit FROM p)
    SELECT r, c, CASE WHEN best >= 0.4 THEN hit ELSE 0 END AS label, round(best, 6) AS confidence FROM t""")
def segmentation_softmax(spark, d):
    z = F.col("z")
    return rounded(detect.decode_segmentation(s.dem_dense(spark, d).select("r", "c", F.array(F.lit(0.0), z / 20, -z / 30).alias("logits")), 0.4))


@query(s.ctes("dem") + """ SELECT r, c, (p >= 0.5)::INT AS label, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence FROM (SELECT r, c, 1 / (1 + exp(-z / 10)) AS p FROM dem)""")
def segmentation_sigmoid(spark, d):
    return rounded(detect.decode_segmentation(s.dem_dense(spark, d).select("r", "c", F.array(F.col("z") / 10).alias("logits")), 0.5))


@query(s.ctes("labels_at") + " SELECT r, c, CASE label WHEN 0 THEN 255 ELSE label END AS label FROM labels_at")
def label_raster(spark, d):
    return detect.label_raster(s.label_grid(spark, d))


@query(s.ctes("labels_at") + " SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM labels_at), 6) AS share FROM labels_at GROUP BY label")
def class_counts(spark, d):
    return rounded(detect.class_counts(s.label_grid(spark, d)))


@query(o.POLYGONS)
def polygonise(spark, d):
    p = detect.polygons(s.label_grid(spark, d), 1.0, 10)
    return rounded(p.select("class_id", "cell_count", "area", "min_r", "max_r", "min_c", "max_c", "mean_confidence"))


@query(o.SEGMENT_SHAPES)
def segment_shapes(spark, d):
    z = F.col("z")
    labels = s.dem_dense(spark, d).select("r", "c", F.when(z > 1, 1).when(z < -1, 2).otherwise(0).alias("label"), F.lit(0.5).alias("confidence"))
    return detect.shapes(labels, 1.0, 10).select(F.col("class_id").cast("int").alias("class_id"), "cell_count", "holes", "wkt")


@query(o.OUTLINES)
def segment_outlines(spark, d):
    return detect.outlines(s.label_grid(spark, d))


def _bright_blocks():
    """A stand-in for a detection model: a box around each 8 x 8 block of its input that is bright on average."""

    def run(x):
        blocks = x[0, 0].reshape(4, 8, 4, 8).mean(axis=(1, 3))
        r, c = np.nonzero(blocks > 0.5)
        return [np.stack([c * 8, r * 8, c * 8 + 8, r * 8 + 8, blocks[r, c], (r + c) % 2], axis=1)[None].astype(np.float32)]

    return run


@query()
def detect_features(spark, d):
    return inference.detect_features(s.dem_dense(spark, d), _bright_blocks, 0.52, 0.3, tile=32, overlap=8, size=(32, 32), labels=_LABELS)


# --- scalars and records ------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, greatest(1, round_even(p_retailprice / 64.0::DOUBLE, 0)::INT) AS px, greatest(1, round_even(p_size / 4.0::DOUBLE, 0)::INT) AS px2,
    printf('%d px = %.1f m', greatest(1, round_even(p_retailprice / 64.0::DOUBLE, 0)::INT), greatest(1, round_even(p_retailprice / 64.0::DOUBLE, 0)::INT) * 64.0::DOUBLE) AS text, greatest(1, round_even(p_retailprice / 4.0::DOUBLE, 0)::INT) > 200 AS slow FROM part""")
def radius_to_pixels(spark, d):
    p = s.table(spark, d, "part")
    px = scale.pixels(F.col("p_retailprice"), "metres", F.lit(64.0))
    return p.select(F.col("p_partkey").alias("id"), px.alias("px"), scale.pixels(F.col("p_size"), "metres", F.lit(4.0)).alias("px2"), scale.describe(px, F.lit(64.0)).alias("text"), scale.too_slow(scale.pixels(F.col("p_retailprice"), "metres", F.lit(4.0))).alias("slow"))


@query("SELECT preset, " + ", ".join(f"greatest(1, round_even({n} / 2.5::DOUBLE, 0)::INT) AS {n}" for n in ("svf", "openness", "slrm", "ld_min")) + """, greatest(round_even(ld_max / 2.5::DOUBLE, 0)::INT, greatest(1, round_even(ld_min / 2.5::DOUBLE, 0)::INT) + 1) AS ld_max,
    observer, directions, noise FROM (VALUES """ + ", ".join("(" + ", ".join([repr(k), *(f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in v.values())]) + ")" for k, v in scale.PRESETS.items()) + ") t(preset, svf, openness, slrm, ld_min, ld_max, observer, directions, noise)")
def terrain_presets(spark, d):
    return scale.presets(spark, 2.5)


@query(r"""SELECT doc_id, regexp_replace(text || ' token=abc' || doc_id, '(?i)\b(api[_-]?key|token|password|secret)\s*([:=])\s*([^\s,;]+)', '\1\2<REDACTED>', 'g') AS text FROM documents""")
def redact_text(spark, d):
    return s.table(spark, d, "documents").select("doc_id", text.redact(F.concat("text", F.lit(" token=abc"), F.col("doc_id").cast("string"))).alias("text"))


@query(r"""SELECT p_partkey AS id, regexp_replace(regexp_replace(p_name || '#' || p_brand, '[^\w.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS component,
    regexp_replace(ltrim(trim(regexp_replace('../' || p_name || ' ' || p_brand, '[^A-Za-z0-9 \-_.]', '_', 'g')), '._/\'), '\s+', '_', 'g') AS project,
    regexp_replace(p_name, '\s+', '_', 'g') || '_svf_manual.tif' AS output FROM part""")
def safe_names(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return s.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.safe_component(F.concat(n, F.lit("#"), b)).alias("component"), text.project_name(F.concat(F.lit("../"), n, F.lit(" "), b)).alias("project"),
        text.output_name("{dem}_{method}_{preset}", F.concat(F.lit("/data/"), n, F.lit(".tif")), F.lit("svf"), F.lit(None).cast("string"), F.lit("2024-01-01")).alias("output"))


@query("""SELECT event_id, replace(replace(replace(replace(replace('<' || props || '>&''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
    replace(replace(replace(replace(replace(replace(props, '{', '%7B'), '"', '%22'), ':', '%3A'), ' ', '%20'), '}', '%7D'), ',', '%2C') AS url FROM events""")
def escapes(spark, d):
    return s.table(spark, d, "events").select("event_id", text.escape_html(F.concat(F.lit("<"), F.col("props"), F.lit(">&'"))).alias("html"), text.encode_url(F.col("props")).alias("url"))


@query("SELECT event_id, round(greatest(least(14 - (user_id * 500) / 5000.0::DOUBLE, 16), 2), 6) AS zoom, round(value, 6) AS value FROM events")
def viewer_numbers(spark, d):
    e = s.table(spark, d, "events")
    return rounded(e.select("event_id", text.zoom_level(F.col("user_id") * 500, 2).alias("zoom"), text.safe_float(F.col("value"), 0.0).alias("value")))


@query("SELECT event_id, [user_id::DOUBLE, 45.0::DOUBLE, (event_id % 360)::DOUBLE] AS azimuths FROM events")
def parse_azimuths(spark, d):
    t = F.concat_ws(", ", F.col("user_id").cast("string"), F.lit("45"), F.pmod("event_id", F.lit(360)).cast("string"))
    return s.table(spark, d, "events").select("event_id", text.azimuths(t).alias("azimuths"))


@query("""SELECT p_partkey AS id, list_filter([CASE WHEN p_size % 5 = 0 THEN 'recipe_version: three numbers expected, found 1.0' END, CASE WHEN p_size % 7 = 0 THEN 'landscape_type: unknown moon' END,
    CASE WHEN p_size % 3 = 0 THEN 'svf.num_directions: whole number expected' END], lambda x: x IS NOT NULL) AS errors FROM part""")
def validate_recipes(spark, d):
    size = F.col("p_size")
    doc = F.concat(
        F.lit('{"recipe_version": "'), F.when(size % 5 == 0, "1.0").otherwise("1.0.0"), F.lit('", "landscape_type": "'), F.when(size % 7 == 0, "moon").otherwise("coastal"),
        F.lit('", "algorithms": {"svf": {"search_radius": 10, "num_directions": '), F.when(size % 3 == 0, '"many"').otherwise("16"), F.lit("}}}"),
    )
    # A small file is one task otherwise, and a text costs far more than its row.
    parts = s.table(spark, d, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.select(F.col("p_partkey").alias("id"), records.recipe_errors(doc).alias("errors"))


@query(s.ctes("dem") + """ SELECT '{"algorithm":"svf","source":{"rows":' || (max(r) + 1) || ',"cols":' || (max(c) + 1) || ',"min":' || round(min(z), 6) || ',"max":' || round(max(z), 6) || ',"valid":' || count(z) || ',"crs":"EPSG:27700","cellsize":1.0},"parameters":{"radius":"10"}}' AS record FROM dem""")
def provenance_record(spark, d):
    return records.provenance(s.dem_dense(spark, d), "EPSG:27700", 1.0, "svf", {"radius": 10})


@query("""SELECT field, recorded, found, recorded IS NOT DISTINCT FROM found AS same FROM (SELECT r_name AS field, r_regionkey::VARCHAR AS recorded FROM region) a
    FULL JOIN (SELECT r_name AS field, (r_regionkey % 2 * r_regionkey)::VARCHAR AS found FROM region WHERE r_regionkey < 4) b USING (field)""")
def verify_provenance(spark, d):
    r = s.table(spark, d, "region")
    return records.verify(r.select(F.col("r_name").alias("field"), F.col("r_regionkey").cast("string").alias("value")), r.where("r_regionkey < 4").select(F.col("r_name").alias("field"), (F.col("r_regionkey") % 2 * F.col("r_regionkey")).cast("string").alias("value")))


@query("SELECT doc_id, sha256(text) || ':' || octet_length(encode(text)) AS checksum FROM documents")
def checksums(spark, d):
    return s.table(spark, d, "documents").select("doc_id", records.checksum(F.col("text").cast("binary")).alias("checksum"))


@query(s.ctes("sparse") + """ SELECT max(r) + 1 AS rows, (max(c) + 1)::BIGINT AS cols, round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std,
    round((count(*) - count(z)) * 100.0::DOUBLE / count(*), 6) AS nodata_percent, round((max(r) + 1) * (max(c) + 1) * 4 / 1048576.0::DOUBLE, 6) AS memory_mb, 'light' AS workload, 'upland_steep' AS preset,
    4 AS fine_px, 20 AS small_px, 100 AS broad_px FROM sparse""")
def preflight(spark, d):
    return rounded(records.preflight(s.dem_sparse(spark, d), 0.5))


@query("""SELECT c_custkey AS id, list_filter([CASE WHEN c_nationkey % 3 = 0 THEN 'no CRS' END, CASE WHEN c_nationkey % 4 = 0 THEN 'geographic CRS' END, CASE WHEN 1 + c_nationkey / 1000.0::DOUBLE - 1 > 0.01 THEN 'pixels are not square' END], lambda x: x IS NOT NULL) AS warnings FROM customer""")
def geometry_warnings(spark, d):
    n = F.col("c_nationkey")
    return s.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), records.geometry_warnings(F.when(n % 3 != 0, "EPSG:27700"), n % 4 == 0, F.lit(1.0), 1 + n / 1000.0).alias("warnings"))


@query("""SELECT s_suppkey AS id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || s_nationkey::DOUBLE || ',' || (s_suppkey % 100)::DOUBLE || ']},"properties":{"title":"' || s_name || '","interpretation":"bank","confidence":"' ||
    CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END || '","visualization":"svf"}}' AS feature FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey % 100 <= 90""")
def interpretation_notes(spark, d):
    k = F.col("s_suppkey")
    conf = F.when(k % 4 == 0, " Low").when(k % 4 == 1, "MEDIUM").when(k % 4 == 2, "high ").otherwise("certain")
    rows = s.table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit(" "), "s_name").alias("title"), F.lit("bank ").alias("interpretation"), conf.alias("confidence"), F.col("s_nationkey").cast("double").alias("longitude"), (k % 100).cast("double").alias("latitude"), F.lit("svf").alias("visualization"))
    return records.notes(rows)


@query("SELECT event_type || user_id AS name, max(ts) AS at, row_number() OVER (ORDER BY max(ts) DESC, event_type || user_id)::INT AS place FROM events GROUP BY 1 ORDER BY 3 LIMIT 8")
def recent_items(spark, d):
    return records.newest(s.table(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("at")), "name", "at", 8)


@query("SELECT event_type || user_id AS name, max(ts) AS at, row_number() OVER (ORDER BY max(ts) DESC, event_type || user_id)::INT AS place FROM events GROUP BY 1 ORDER BY 3 LIMIT 50")
def bookmarks(spark, d):
    return records.newest(s.table(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("name"), F.col("ts").alias("at")), "name", "at", 50)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN ['filters.' || p_type] ELSE []::VARCHAR[] END AS unknown FROM part")
def pipeline_stages(spark, d):
    stages = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("readers.las"), F.concat(F.lit("filters."), F.col("p_type")))).otherwise(F.array(F.lit("readers.las"), F.lit("filters.pmf")))
    return s.table(spark, d, "part").select(F.col("p_partkey").alias("id"), records.unknown_stages(stages).alias("unknown"))


@query("SELECT user_id AS run, event_type AS message, min(ts) AS seen FROM events GROUP BY ALL")
def run_warnings(spark, d):
    return records.first_warnings(s.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("message"), F.col("ts").alias("at"))).withColumnRenamed("at", "seen")
