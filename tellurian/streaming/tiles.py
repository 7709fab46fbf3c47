"""Incremental gridding: arriving points refresh the tiles they change, and the slopes of those tiles and their neighbours.

An addition to the batch operators: the surface is the lowest point of every
cell, and after any batches it and its slopes equal what :func:`lowest` and
:func:`slopes` make of all points at once.

The state is kept by tile and version under a target folder.  A batch writes
the tiles that it changes, the slopes of those and of the tiles beside them, and
a list that says for every tile which version holds now.  It builds on the list
before its own number, so that a batch that is replayed after a failure replaces
itself; tiles that it does not touch stay where they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tellurian.operators.stencil import slope_of

TILE = ("tile_r", "tile_c")
CELLS, SLOPES = "r long, c int, z double", "r long, c int, slope double"


def windowed_levels(points: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Lowest, highest and number of readings per event-time window; later ones are dropped."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count("z").alias("n"))


def lowest(points: DataFrame, cellsize: float) -> DataFrame:
    """(r, c, z): the lowest point of every cell that has one; points without coordinates are left out."""
    whole = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND NOT isnan(z)")
    return whole.groupBy(F.floor(F.col("y") / cellsize).alias("r"), F.floor(F.col("x") / cellsize).cast("int").alias("c")).agg(F.min("z").alias("z"))


def slopes(cells: DataFrame, cellsize: float) -> DataFrame:
    """(r, c, slope) in degrees by Horn's weights; a missing neighbour counts as the cell beside it.

    So a slope depends on the cells around it only, wherever the surface ends.
    """
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    near = lambda f, v, k, step, w: F.coalesce(F.when(f(k).over(w) == F.col(k) + step, f(v).over(w)), F.col(v))
    d = cells.select("r", "c", "z").withColumns({"w": near(F.lag, "z", "c", -1, row), "e": near(F.lead, "z", "c", 1, row)})
    d = d.withColumns({f"{v}{s}": near(f, v, "r", step, col) for v in ("z", "w", "e") for s, f, step in (("n", F.lag, -1), ("s", F.lead, 1))})
    g = F.col
    east, west = g("en") + 2.0 * g("e") + g("es"), g("wn") + 2.0 * g("w") + g("ws")
    south, north = g("ws") + 2.0 * g("zs") + g("es"), g("wn") + 2.0 * g("zn") + g("en")
    d = d.withColumns({"dz_dx": (east - west) / (8.0 * cellsize), "dz_dy": (south - north) / (8.0 * cellsize)})
    return d.select("r", "c", slope_of().alias("slope"))


def _placed(cells: DataFrame, tile: int) -> DataFrame:
    return cells.withColumns({k: F.floor(F.col(n) / tile).cast("int") for k, n in zip(TILE, ("r", "c"), strict=True)})


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the state, empty before anything was written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _list(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(tile_r, tile_c, cells_v, slopes_v): the versions that hold, or held before a batch; a row for each tile."""
    every = _read(spark, f"{target}/list", "tile_r int, tile_c int, cells_v long, slopes_v long, v long")
    every = every if before is None else every.where(F.col("v") < before)
    newest = every.agg(F.max("v")).first()[0]
    return every.where(F.lit(newest is not None) & (F.col("v") == F.lit(newest if newest is not None else -1))).drop("v")


def _held(spark: SparkSession, target: str, part: str, held: DataFrame, schema: str) -> DataFrame:
    """The rows of the tiles in ``held`` at the versions that it names."""
    v = f"{part}_v"
    table = _read(spark, f"{target}/{part}", f"{schema}, v long, tile_r int, tile_c int")
    return table.join(held.select(*TILE, F.col(v).alias("v")).where("v IS NOT NULL"), [*TILE, "v"], "left_semi")


def _around(tiles: DataFrame) -> DataFrame:
    """The tiles and the eight beside each."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return tiles.select("tile_r", "tile_c", F.explode(steps).alias("s")).select((F.col("tile_r") + F.col("s.i")).alias("tile_r"), (F.col("tile_c") + F.col("s.j")).alias("tile_c")).distinct()


def refresh(points: DataFrame, number: int, target: str, cellsize: float, tile: int = 256) -> None:
    """Takes a batch of points (x, y, z) in under its number; once more under the same number changes nothing."""
    spark = points.sparkSession
    before = _list(spark, target, number).persist()
    fresh = _placed(lowest(points, cellsize), tile).persist()
    met = fresh.select(*TILE).distinct()
    old = _held(spark, target, "cells", before.join(met, [*TILE], "left_semi"), CELLS)
    lower = fresh.join(old.select("r", "c", F.col("z").alias("old")), ["r", "c"], "left").where("old IS NULL OR z < old")
    # Tiles where a cell is new or lower; the others stay as they are.
    changed = lower.select(*TILE).distinct().persist()
    both = old.select("r", "c", "z", *TILE).unionByName(fresh.select("r", "c", "z", *TILE)).join(changed, [*TILE], "left_semi")
    _write(both.groupBy("r", "c", *TILE).agg(F.min("z").alias("z")), f"{target}/cells", number)
    now = before.select(*TILE, "cells_v", "slopes_v").join(changed.withColumn("new", F.lit(number).cast("long")), [*TILE], "full")
    now = now.select(*TILE, F.coalesce("new", "cells_v").alias("cells_v"), "slopes_v").persist()
    stale = _around(changed).join(now.select(*TILE), [*TILE], "left_semi").persist()
    ground = _held(spark, target, "cells", now.join(_around(stale), [*TILE], "left_semi"), CELLS)
    steep = _placed(slopes(ground, cellsize), tile).join(stale, [*TILE], "left_semi")
    _write(steep, f"{target}/slopes", number)
    listed = now.join(stale.withColumn("new", F.lit(number).cast("long")), [*TILE], "left").select(*TILE, "cells_v", F.coalesce("new", "slopes_v").alias("slopes_v"))
    # The list goes last: a batch that fails before leaves the state as it was.
    listed.coalesce(1).write.mode("overwrite").parquet(f"{target}/list/v={number}")
    for d in (before, fresh, changed, now, stale):
        d.unpersist()


def _write(rows: DataFrame, path: str, number: int) -> None:
    names = [n for n in rows.columns if n not in TILE]
    rows.repartition(*TILE).select(*names, *TILE).write.mode("overwrite").partitionBy(*TILE).parquet(f"{path}/v={number}")


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, cellsize: float, tile: int = 256, files: int = 1000) -> StreamingQuery:
    """Keeps the surface and its slopes under ``target`` from point files that arrive in ``source``; see the module."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    take = lambda batch, number: refresh(batch, number, target, cellsize, tile)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """(r, c, z): the surface so far."""
    return _held(spark, target, "cells", _list(spark, target), CELLS).select("r", "c", "z")


def current_slopes(spark: SparkSession, target: str) -> DataFrame:
    """(r, c, slope): the slopes so far."""
    return _held(spark, target, "slopes", _list(spark, target), SLOPES).select("r", "c", "slope")
