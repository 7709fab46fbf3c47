"""The cell-table contract: grid statistics, nodata, tiles and their halos."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODATA = -9999.0


@dataclass(frozen=True)
class GridStats:
    """Bounds and mean of a cell table; one small aggregate on the driver."""

    mean: float | None
    first_r: int
    last_r: int
    first_c: int
    last_c: int


def grid_stats(cells: DataFrame, value: str = "z") -> GridStats:
    row = cells.agg(F.avg(value), F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return GridStats(row[0], *(0 if v is None else int(v) for v in row[1:]))


def from_nodata(cells: DataFrame, nodata: float | None = NODATA, value: str = "z") -> DataFrame:
    """Tagged (within 1e-5) and NaN values become NULL."""
    v = F.col(value)
    missing = F.isnan(v) | (F.abs(v - nodata) <= 1e-5) if nodata is not None else F.isnan(v)
    return cells.withColumn(value, F.when(~missing, v))


def to_nodata(cells: DataFrame, nodata: float = NODATA, value: str = "z") -> DataFrame:
    return cells.withColumn(value, F.coalesce(value, F.lit(nodata)))


def mask_like(out: Column, source: Column) -> Column:
    """Nodata cells of the source stay nodata."""
    return F.when(source.isNotNull(), out)


def complete(cells: DataFrame, stats: GridStats | None = None) -> DataFrame:
    """Adds the cells of the bounding rectangle that a table leaves out, as NULL."""
    s = stats or grid_stats(cells)
    spark = cells.sparkSession
    rows = spark.range(s.first_r, s.last_r + 1).withColumnRenamed("id", "r")
    grid = rows.select("r", F.explode(F.sequence(F.lit(s.first_c), F.lit(s.last_c))).alias("c"))
    return grid.join(cells, ["r", "c"], "left")


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """tile_r, tile_c of each cell, row-major windows of ``size`` cells."""
    return cells.withColumns({"tile_r": F.floor(F.col("r") / size), "tile_c": F.floor(F.col("c") / size)})


def haloed(cells: DataFrame, size: int, halo: int) -> DataFrame:
    """Each cell once for every tile whose halo holds it; ``is_core`` in its own.

    One shuffle on (tile_r, tile_c) then serves any neighbourhood operator of
    radius ``halo``; the share of copies is (1 + 2 halo / size)^2 at most.
    """
    reach = lambda x: F.sequence(F.floor((F.col(x) - halo) / size), F.floor((F.col(x) + halo) / size))
    spread = cells.withColumn("tile_r", F.explode(reach("r"))).withColumn("tile_c", F.explode(reach("c")))
    core = (F.floor(F.col("r") / size) == F.col("tile_r")) & (F.floor(F.col("c") / size) == F.col("tile_c"))
    return spread.withColumn("is_core", core)


def downsample(cells: DataFrame, max_dim: int, stats: GridStats | None = None) -> DataFrame:
    """Nearest-sample preview whose longer side has at most ``max_dim`` cells."""
    s = stats or grid_stats(cells)
    rows, cols = s.last_r - s.first_r + 1, s.last_c - s.first_c + 1
    scale = max(1.0, max(rows, cols) / max_dim)
    out_r, out_c = max(1, int(rows / scale)), max(1, int(cols / scale))
    place = lambda x, first, n, out: F.floor((F.col(x) - first) * out / n)
    # The source cell under each preview cell's centre.
    centre = lambda i, n, out: F.floor((i + 0.5) * n / out)
    pr, pc = place("r", s.first_r, rows, out_r), place("c", s.first_c, cols, out_c)
    keep = (centre(pr, rows, out_r) == F.col("r") - s.first_r) & (centre(pc, cols, out_c) == F.col("c") - s.first_c)
    return cells.where(keep).select(pr.alias("r"), pc.cast("int").alias("c"), "z")


def extent(origin_x: float, pixel_w: float, rot_x: float, origin_y: float, rot_y: float, pixel_h: float, rows: int, cols: int) -> tuple[float, float, float, float]:
    """(x_min, y_min, x_max, y_max) over the four affine corners."""
    xs = [origin_x + i * pixel_w + j * rot_x for i in (0, cols) for j in (0, rows)]
    ys = [origin_y + i * rot_y + j * pixel_h for i in (0, cols) for j in (0, rows)]
    return min(xs), min(ys), max(xs), max(ys)


def cell_size(pixel_w: float, pixel_h: float) -> float:
    return (abs(pixel_w) + abs(pixel_h)) / 2
