"""3x3 stencils and box windows as Spark window expressions.

Grids are complete cell tables.  Row windows (partition by r) come first, column
windows second: two shuffles for any number of derived columns.  Box sums are
differences of running sums, so their cost does not depend on the radius.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurian.operators.grid import GridStats, grid_stats


def along_row():
    return Window.partitionBy("r").orderBy("c")


def along_column():
    return Window.partitionBy("c").orderBy("r")



def filled(cells: DataFrame, stats: GridStats | None = None) -> DataFrame:
    """Adds f: the value, or the grid's mean for nodata."""
    s = stats or grid_stats(cells)
    return cells.withColumn("f", F.coalesce("z", F.lit(s.mean)))


def _sides(df: DataFrame, names: Sequence[str], w, before: str, after: str) -> DataFrame:
    """Neighbours along one axis; the grid's edge repeats the cell itself."""
    wrap = lambda f, n: F.coalesce(f(F.struct(n)).over(w), F.struct(n))[n]
    return df.withColumns({f"{n}_{s}": wrap(f, n) for n in names for s, f in ((before, F.lag), (after, F.lead))})


def neighbourhood(df: DataFrame, value: str) -> DataFrame:
    """Adds value_w, value_e and, of each of the three, _n and _s: all eight neighbours."""
    df = _sides(df, [value], along_row(), "w", "e")
    return _sides(df, [value, f"{value}_w", f"{value}_e"], along_column(), "n", "s")


def gradients(cells: DataFrame, cellsize: float, method: str = "horn", stats: GridStats | None = None) -> DataFrame:
    """Adds dz_dx, dz_dy: Horn's 1-2-1 weights, or central differences."""
    d = neighbourhood(filled(cells, stats), "f")
    g = F.col
    if method == "horn":
        east, west = g("f_e_n") + 2.0 * g("f_e") + g("f_e_s"), g("f_w_n") + 2.0 * g("f_w") + g("f_w_s")
        south, north = g("f_w_s") + 2.0 * g("f_s") + g("f_e_s"), g("f_w_n") + 2.0 * g("f_n") + g("f_e_n")
        span = 8.0 * cellsize
    elif method == "central":
        east, west, south, north, span = g("f_e"), g("f_w"), g("f_s"), g("f_n"), 2.0 * cellsize
    else:
        raise ValueError(f"Unknown gradient method: {method}")
    return d.select("r", "c", "z", "f", ((east - west) / span).alias("dz_dx"), ((south - north) / span).alias("dz_dy"))


def slope_of(units: str = "degrees") -> Column:
    steep = F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy"))
    if units == "degrees":
        return F.degrees(F.atan(steep))
    if units == "percent":
        return steep * 100.0
    raise ValueError(f"Unknown slope units: {units}")


def slope(cells: DataFrame, cellsize: float, units: str = "degrees", method: str = "horn", stats: GridStats | None = None) -> DataFrame:
    g = gradients(cells, cellsize, method, stats)
    return g.select("r", "c", F.when(F.col("z").isNotNull(), slope_of(units)).alias("slope"))


def shade_of(azimuth: float, altitude: float) -> Column:
    """Illumination in 0..1 from one sun; aspect points uphill, so slopes rising to the sun are bright."""
    sun, zenith = F.radians(F.lit(450.0 - float(azimuth) % 360.0)), F.radians(F.lit(90.0 - float(altitude)))
    tilt = F.atan(F.sqrt(F.col("dz_dx") * F.col("dz_dx") + F.col("dz_dy") * F.col("dz_dy")))
    aspect = F.atan2(-F.col("dz_dy"), F.col("dz_dx"))
    lit = F.cos(tilt) * F.cos(zenith) + F.sin(tilt) * F.sin(zenith) * F.cos(sun - aspect)
    return F.greatest(F.least(lit, F.lit(1.0)), F.lit(0.0))


#: The six default suns.
DEFAULT_AZIMUTHS = (315.0, 45.0, 135.0, 225.0, 270.0, 0.0)


def hillshade(cells: DataFrame, cellsize: float, azimuths: Sequence[float] = DEFAULT_AZIMUTHS, altitude: float = 45.0) -> DataFrame:
    """Mean illumination over the suns, times 255."""
    total = F.lit(0.0)
    for a in azimuths:
        total = total + shade_of(a, altitude)
    g = gradients(cells, cellsize)
    return g.select("r", "c", F.when(F.col("z").isNotNull(), total / len(azimuths) * 255.0).alias("hillshade"))


def hillshade_bands(cells: DataFrame, cellsize: float, directions: int = 16, altitude: float = 45.0) -> DataFrame:
    """One band per evenly spaced sun, in long form (r, c, band, v)."""
    g = gradients(cells, cellsize)
    shades = F.array(*[shade_of(360.0 * k / directions, altitude) for k in range(directions)])
    return g.where("z IS NOT NULL").select("r", "c", F.posexplode(shades).alias("band", "v"))


def ruggedness(cells: DataFrame) -> DataFrame:
    """Root of the summed squared differences to eight neighbours; nodata neighbours add nothing."""
    d = neighbourhood(cells, "z")
    squares = [F.coalesce(F.pow(F.col(n) - F.col("z"), 2), F.lit(0.0)) for n in ("z_w_n", "z_n", "z_e_n", "z_w", "z_e", "z_w_s", "z_s", "z_e_s")]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    return d.select("r", "c", F.when(F.col("z").isNotNull(), F.sqrt(total)).alias("tri"))


def _mirrored(df: DataFrame, axis: str, first: int, last: int, radius: int) -> DataFrame:
    """Repeats cells beyond the edges, the edge cell first (d c b a | a b c d | d c b a), by radius cells."""
    n = last - first + 1
    copies = F.sequence(F.floor(F.lit(-radius) / (2 * n)).cast("int") - 1, F.ceil(F.lit(n + radius) / (2 * n)).cast("int") + 1)
    at = F.col(axis) - first
    places = F.flatten(F.transform(copies, lambda k: F.array(k * 2 * n + at, k * 2 * n - 1 - at)))
    inside = F.filter(places, lambda p: (p >= -radius) & (p < n + radius))
    return df.withColumn("__p", F.explode(inside)).withColumn(axis, F.col("__p") + first).drop("__p")


def box_mean(df: DataFrame, value: str, radius: int, stats: GridStats) -> DataFrame:
    """Mean over (2 radius + 1)^2 cells with mirrored edges, one axis after the other.

    A mean is a difference of running sums, so that a cell costs the same at any
    radius; the edges add ``radius`` cells on either side of a row or column.
    """
    out = df.select("r", "c", F.col(value).alias("m"))
    for axis, other, first, last in (("r", "c", stats.first_r, stats.last_r), ("c", "r", stats.first_c, stats.last_c)):
        line = Window.partitionBy(other).orderBy(axis)
        wide = _mirrored(out, axis, first, last, radius).withColumn("run", F.sum("m").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        total = F.lead("run", radius).over(line) - F.coalesce(F.lag("run", radius + 1).over(line), F.lit(0.0))
        out = wide.select("r", "c", (total / (2 * radius + 1)).alias("m")).where(F.col(axis).between(first, last))
    return out


def local_relief(cells: DataFrame, radius: int = 20, stats: GridStats | None = None) -> DataFrame:
    """Elevation less its box mean."""
    if radius < 1:
        raise ValueError("radius must be at least 1")
    s = stats or grid_stats(cells)
    # From the grid's mean, so that sums over long lines keep their digits.
    d = filled(cells, s).withColumn("f", F.col("f") - F.lit(s.mean or 0.0))
    mean = box_mean(d, "f", radius, s)
    return d.join(mean, ["r", "c"]).select("r", "c", F.when(F.col("z").isNotNull(), F.col("f") - F.col("m")).alias("slrm"))


def _running_windows(df: DataFrame, sums: dict[str, tuple[str, int]], axis: str, other: str) -> DataFrame:
    """Sums over the cells within a radius along an axis, clipped at the edges, by running sums.

    ``sums`` maps a new column to (column, radius); all of them share one shuffle.
    """
    line = Window.partitionBy(other).orderBy(axis)
    sources = sorted({n for n, _ in sums.values()})
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumns({f"__{n}": F.sum(n).over(upto) for n in sources} | {f"__t_{n}": F.sum(n).over(Window.partitionBy(other)) for n in sources})
    window = lambda n, radius: F.coalesce(F.lead(f"__{n}", radius).over(line), F.col(f"__t_{n}")) - F.coalesce(F.lag(f"__{n}", radius + 1).over(line), F.lit(0.0))
    return d.withColumns({out: window(n, radius) for out, (n, radius) in sums.items()}).drop(*[f"__{n}" for n in sources], *[f"__t_{n}" for n in sources])


def deviations(d: DataFrame, radii: dict[str, int], stats: GridStats) -> DataFrame:
    """(r, c, z, a column per radius): standardised deviation from the clipped window's mean; flat windows give 0.

    ``d`` has z and the filled value f.  The windows of all radii share two
    shuffles, one along rows and one along columns; how many cells a window has
    follows from its place.  Values are taken from the grid's mean, so that sums over
    long lines keep their digits.
    """
    centred = F.col("f") - F.lit(stats.mean or 0.0)
    s = d.select("r", "c", "z", centred.alias("f")).withColumn("ff", F.col("f") * F.col("f"))
    s = _running_windows(s, {f"{n}_{k}": (k, radius) for n, radius in radii.items() for k in ("f", "ff")}, "c", "r")
    s = _running_windows(s, {f"{n}_{k}": (f"{n}_{k}", radius) for n, radius in radii.items() for k in ("f", "ff")}, "r", "c")
    span = lambda x, first, last, radius: F.least(F.col(x) + radius, F.lit(last)) - F.greatest(F.col(x) - radius, F.lit(first)) + 1
    out = []
    for name, radius in radii.items():
        n = span("r", stats.first_r, stats.last_r, radius) * span("c", stats.first_c, stats.last_c, radius)
        mean = F.col(f"{name}_f") / n
        std = F.sqrt(F.greatest(F.col(f"{name}_ff") / n - mean * mean, F.lit(0.0)))
        out.append(F.when(std < 0.001, 0.0).otherwise((F.col("f") - mean) / std).alias(name))
    return s.select("r", "c", "z", *out)


def deviation(cells: DataFrame, radius: int, name: str) -> DataFrame:
    """(r, c, name): the deviation within one radius."""
    s = grid_stats(cells)
    return deviations(filled(cells, s), {name: radius}, s).select("r", "c", name)


def check_windows(local: int, meso: int, broad: int) -> None:
    if not 1 <= local < meso < broad:
        raise ValueError("Window radii must rise from local over meso to broad")


def position_byte(deviation: Column, lightness: float = 1.0) -> Column:
    """A deviation as 0..255, 127 being none; black where z is null."""
    return F.when(F.col("z").isNull(), 0).otherwise(F.greatest(F.least(127 + deviation * 50.0 * lightness, F.lit(255.0)), F.lit(0.0)).cast("int"))


def mstp(cells: DataFrame, local: int = 5, meso: int = 50, broad: int = 500, lightness: float = 1.0, stats: GridStats | None = None) -> DataFrame:
    """red, green, blue in 0..255 from the broad, meso and local deviation; nodata is black."""
    check_windows(local, meso, broad)
    s = stats or grid_stats(cells)
    out = deviations(filled(cells, s), {"red": broad, "green": meso, "blue": local}, s)
    return out.select("r", "c", *[position_byte(F.col(n), lightness).alias(n) for n in ("red", "green", "blue")])


def integral_image(cells: DataFrame) -> DataFrame:
    """Running sums of the filled value and its square over all cells above and to the left."""
    run_c, run_r = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (along_row(), along_column()))
    d = filled(cells).withColumns({"s1": F.sum("f").over(run_c), "s2": F.sum(F.col("f") * F.col("f")).over(run_c)})
    return d.select("r", "c", F.sum("s1").over(run_r).alias("sum_z"), F.sum("s2").over(run_r).alias("sum_sq"))
