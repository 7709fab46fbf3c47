"""Cell-local algebra: blends, stretches and composites over aligned layers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.operators import horizon, stencil
from tellurian.operators.grid import grid_stats
from tellurian.operators.lineage import cut
from tellurian.operators.quantiles import quantiles


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


#: Base and active layer in 0..1 -> blended layer in 0..1.
MODES: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda a, b: a * b,
    "screen": lambda a, b: 1.0 - (1.0 - a) * (1.0 - b),
    "overlay": lambda a, b: F.when(a < 0.5, 2.0 * a * b).otherwise(1.0 - 2.0 * (1.0 - a) * (1.0 - b)),
    "soft_light": lambda a, b: (1.0 - 2.0 * b) * a * a + 2.0 * b * a,
}


def blend(a: Column, b: Column, mode: str, opacity: float = 1.0) -> Column:
    """Two layers in 0..255; null where either is."""
    if mode not in MODES:
        raise ValueError(f"Unknown blend mode: {mode}")
    x, y = clip(a / 255.0, 0.0, 1.0), clip(b / 255.0, 0.0, 1.0)
    return clip((opacity * MODES[mode](x, y) + (1.0 - opacity) * x) * 255.0, 0.0, 255.0)


def extremes(df: DataFrame, *names: str) -> dict[str, tuple[float | None, float | None]]:
    """(least, greatest) of each column, in one pass."""
    row = df.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
    return {n: (row[2 * i], row[2 * i + 1]) for i, n in enumerate(names)}


def unit_range(x: Column, low: float | None, high: float | None, flat: float = 0.5, least: float = 0.0) -> Column:
    """Min-max scaling to 0..1; a constant layer becomes ``flat``."""
    if low is None or high - low <= least:
        return F.when(x.isNotNull(), F.lit(flat))
    return (x - low) / (high - low)


def percentile_stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(r, c, byte): 2-98 percentile stretch; a constant layer is 127, nodata 24."""
    a, b = quantiles(df, value, (low, high)) or (None, None)
    x = F.col(value)
    scaled = F.lit(127) if a is None or b <= a else (clip((x - a) / (b - a), 0.0, 1.0) * 255.0).cast("int")
    return df.select("r", "c", F.when(x.isNull(), 24).otherwise(scaled).alias("byte"))


def deviation_stretch(df: DataFrame, value: str, deviations: float = 2.0) -> tuple[float, float]:
    """Display range: mean -/+ deviations, inside the data's own range; (0, 0) without any value."""
    low, high, mean, std = df.agg(F.min(value), F.max(value), F.avg(value), F.stddev_pop(value)).first()
    if low is None:
        return 0.0, 0.0
    return max(low, mean - deviations * std), min(high, mean + deviations * std)


def scaled_inputs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Blend inputs as 0..255: layers in 0..1 times 255, a layer b with negatives stretched."""
    e = extremes(df, a, b)
    times = lambda n: F.col(n) * 255.0 if e[n][0] is not None and e[n][0] >= 0 and e[n][1] <= 1 else F.col(n)
    second = unit_range(F.col(b), *e[b]) * 255.0 if e[b][0] is not None and e[b][0] < 0 else times(b)
    return df.select("r", "c", times(a).alias(a), second.alias(b))


def aligned(*layers: DataFrame) -> DataFrame:
    """Equi-join of layers on (r, c)."""
    out = layers[0]
    for x in layers[1:]:
        out = out.join(x, ["r", "c"])
    return out


def stacked(layers: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long (r, c, band, v) to one column per band; with their names given, the bands need not be looked for first."""
    return layers.groupBy("r", "c").pivot("band", names).agg(F.first("v"))


def mosaic(*layers: DataFrame) -> DataFrame:
    """Union of tables where the last one that has a cell wins."""
    tagged = [x.select("r", "c", "z", F.lit(i).alias("at")) for i, x in enumerate(layers)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    return out.where("z IS NOT NULL").groupBy("r", "c").agg(F.max_by("z", "at").alias("z"))


def _vat(d: DataFrame, e: dict, layers: dict[str, str], out: str) -> DataFrame:
    """Adds hillshade x inverted slope, overlaid with openness, times sky view, each at half opacity."""
    unit = lambda n: unit_range(F.col(layers[n]), *e[layers[n]]) * 255.0
    d = d.withColumn(out, unit("shade"))
    # One projection a blend: nested, each would repeat the one below it several times.
    for layer, mode in (("slope", "multiply"), ("opn", "overlay"), ("svf", "multiply")):
        d = d.withColumn(out, blend(F.col(out), 255.0 - unit(layer) if layer == "slope" else unit(layer), mode, 0.5))
    return d


def vat(cells: DataFrame, cellsize: float, svf_radius: int = 50, open_radius: int = 50) -> DataFrame:
    """Hillshade x inverted slope, overlaid with openness, times sky view, each at half opacity."""
    return batch(cells, cellsize, ("vat",), vat_radii=(svf_radius, open_radius))


def _red(d: DataFrame, e: dict, relief: str, slope: str, out: str) -> DataFrame:
    """Adds local relief times inverted slope at half opacity; a constant layer counts as 0."""
    flat = lambda n: e[n][0] is None or e[n][1] <= e[n][0]
    high = F.when(F.col(relief).isNotNull(), F.lit(0.0)) if flat(relief) else unit_range(F.col(relief), *e[relief]) * 255.0
    steep = F.when(F.col(slope).isNotNull(), F.lit(0.0)) if flat(slope) else (1.0 - unit_range(F.col(slope), *e[slope])) * 255.0
    return d.withColumn(out, blend(high, steep, "multiply", 0.5))


def red_relief(cells: DataFrame, cellsize: float, radius: int = 20) -> DataFrame:
    """Local relief times inverted slope at half opacity; a constant layer counts as 0."""
    return batch(cells, cellsize, ("red_relief",), trend=radius)


def e4mstp(d: DataFrame, keep: tuple[str, ...] = (), out: tuple[str, str, str] = ("red", "green", "blue")) -> DataFrame:
    """r, c, ``keep`` and three bands from o_pos, o_neg, ld, s and mstp_r, mstp_g, mstp_b in 0..1 with svf_s, svf_l; null gives 0.

    Texture under a red slope, darkened by two sky views, overlaid with the
    multi-scale position at 90 %.
    """
    sky = lambda n, low: clip((F.coalesce(F.col(n), F.lit(1.0)) - low) / (1.0 - low), 0.0, 1.0)
    open_sky = (sky("svf_l", 0.9) + sky("svf_s", 0.7) * 0.5) / 1.5
    texture = F.col("o_pos") * F.col("o_neg") * F.col("ld") * (1.0 - F.col("s"))
    positions = ("mstp_r", "mstp_g", "mstp_b")
    staged = d.select("r", "c", *keep, *positions, F.col("s").alias("rough"), texture.alias("texture"), open_sky.alias("sky"))
    under = lambda n: 0.25 * F.col(n) * F.col("sky") + 0.75 * F.col(n)
    staged = staged.select("r", "c", *keep, *positions, *[under(n).alias(f"under_{i}") for i, n in enumerate(("rough", "texture", "texture"))])
    mixed = staged.select("r", "c", *keep, *[((0.9 * MODES["overlay"](F.col(f"under_{i}"), F.col(p)) + 0.1 * F.col(f"under_{i}")) * 255.0).alias(f"mixed_{i}") for i, p in enumerate(positions)])
    return mixed.select("r", "c", *keep, *[F.coalesce(clip(F.col(f"mixed_{i}"), 0.0, 255.0), F.lit(0.0)).cast("int").alias(n) for i, n in enumerate(out)])


#: Fixed values of the composite: radii of openness and of the near and far sky view, directions, rings of local dominance, and window radii.
E4MSTP = {"radius": 10, "near": 10, "far": 50, "directions": 16, "ring": (10.0, 20.0), "angle": 15.0, "observer": 1.7, "windows": (3, 20, 100)}


def _e4mstp_rays(p: dict) -> dict[str, tuple[str, dict]]:
    way = {"directions": p["directions"]}
    return {
        "svf_s": ("svf", {"radius": p["near"], **way}), "svf_l": ("svf", {"radius": p["far"], **way}), "o_pos": ("openness", {"radius": p["radius"], **way}),
        "o_neg": ("openness", {"radius": p["radius"], "negative": True, **way}), "ld": ("local_dominance", {"min_radius": p["ring"][0], "max_radius": p["ring"][1], "angle": p["angle"], "observer": p["observer"]}),
    }


def e4mstp_halo(**settings) -> int:
    """How many cells around a tile the composite looks at: its farthest ray or its widest window."""
    p = {**E4MSTP, **settings}
    return max(max(horizon.KERNELS[kind][1](given) for kind, given in _e4mstp_rays(p).values()), max(p["windows"]))


def e4mstp_of(cells: DataFrame, cellsize: float, **settings) -> DataFrame:
    """red, green, blue of the composite from elevations: all ray layers in one scan; ``settings`` are those of :data:`E4MSTP`."""
    found = batch(cells, cellsize, ("e4mstp",), e4mstp_settings=settings)
    return found.toDF("r", "c", "red", "green", "blue")


def moments(d: DataFrame, names: tuple[str, ...]) -> tuple[list[float], list[float], np.ndarray] | None:
    """Means, population deviations (1 for a constant layer) and the covariance of the standardised layers, in one aggregate.

    Cells where any layer is null are left out; None if none is left.
    """
    whole = d.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = whole.agg(*[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names], *[F.covar_samp(a, b) for a, b in pairs]).first()
    k = len(names)
    if row[0] is None:
        return None
    std = [s or 1.0 for s in row[k : 2 * k]]
    cov = np.zeros((k, k))
    for (a, b), v in zip(pairs, row[2 * k :], strict=True):
        i, j = names.index(a), names.index(b)
        cov[i, j] = cov[j, i] = (v or 0.0) / (std[i] * std[j])
    return list(row[:k]), std, cov


def components(d: DataFrame, names: tuple[str, ...], n: int = 3) -> list[Column]:
    """Leading components of standardised layers in 0..255 as columns over ``d``, which is read for moments and percentiles.

    Moments come from one aggregate, the eigenvectors of the small covariance from
    numpy on the driver; a component's sign makes its largest weight positive.
    """
    found = moments(d, names)
    if found is None:
        return [F.lit(0.0)] * n
    mean, std, cov = found
    _, vectors = np.linalg.eigh(cov)
    weights = vectors[:, ::-1][:, :n].T
    weights = [w * np.sign(w[np.abs(w).argmax()]) for w in weights]
    total = lambda w: sum(((F.col(k) - m) / s * float(x) for k, m, s, x in zip(names, mean, std, w, strict=True)), F.lit(0.0))
    out = []
    for w in weights:
        low, high = quantiles(d.select("r", "c", total(w).alias("pc")), "pc", (0.02, 0.98)) or (0.0, 0.0)
        out.append(clip((total(w) - low) / (high - low) * 255.0, 0.0, 255.0) if high > low else F.when(total(w).isNotNull(), F.lit(0.0)))
    return out


def pca(d: DataFrame, names: tuple[str, ...] = ("svf", "opn", "slope", "ld"), n: int = 3) -> DataFrame:
    """pc1, pc2, pc3 in 0..255: :func:`components` with a 2-98 percentile stretch."""
    return d.select("r", "c", *[c.alias(f"pc{i + 1}") for i, c in enumerate(components(d, names, n))])


def pca_layers(cells: DataFrame, cellsize: float, radius: int = 10) -> DataFrame:
    """(r, c, svf, opn, ld, slope): the layers whose components are taken."""
    s = grid_stats(cells)
    rays = horizon.layers(cells, cellsize, {"svf": ("svf", {"radius": radius}), "opn": ("openness", {"radius": radius}), "ld": ("local_dominance", {})}, stats=s)
    return aligned(rays, stencil.slope(cells, cellsize, stats=s))


def pca_of(cells: DataFrame, cellsize: float, radius: int = 10) -> DataFrame:
    # Read several times: moments, percentiles, result.
    return pca(cut(pca_layers(cells, cellsize, radius)))


def report_statistics(cells: DataFrame, value: str = "z") -> DataFrame:
    """One row: bounds, mean, population deviation, percentiles and counts."""
    v = F.col(value)
    shares = (5, 25, 50, 75, 95)
    at = quantiles(cells, value, [p / 100 for p in shares]) or [None] * len(shares)
    return cells.agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        *[F.lit(q).cast("double").alias(f"p{p}") for p, q in zip(shares, at, strict=True)],
        F.count(v).alias("valid"), (F.count(F.lit(1)) - F.count(v)).alias("nodata"),
    )


def histogram(cells: DataFrame, value: str = "z", bins: int = 100) -> DataFrame:
    """(bin, n): equal bins between the extremes, the last one closed."""
    low, high = extremes(cells, value)[value]
    if low is None:
        return cells.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return cells.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """(level, r, c, z): overviews by repeated 2 x 2 means of valid cells."""
    current = cells.select(F.lit(0).alias("level"), "r", "c", "z")
    out = current
    for level in range(1, levels + 1):
        current = current.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.avg("z").alias("z")).select(F.lit(level).alias("level"), "r", "c", "z")
        out = out.unionByName(current)
    return out


def overview_levels(rows: int, cols: int) -> int:
    """Number of overviews of a grid; none up to 512 cells a side."""
    longest = max(rows, cols)
    return max(1, (longest // 256).bit_length() - 1) if longest > 512 else 0


#: Products of a batch run and the columns of each.
BATCH = {
    "hillshade": ("hillshade",), "slrm": ("slrm",), "svf": ("svf",), "slope": ("slope",), "openness": ("openness",), "mstp": ("mstp_red", "mstp_green", "mstp_blue"), "vat": ("vat",),
    "red_relief": ("red_relief",), "local_dominance": ("local_dominance",), "asvf": ("asvf",), "e4mstp": ("e4mstp_red", "e4mstp_green", "e4mstp_blue"), "pca": ("pc1", "pc2", "pc3"),
}
#: Those that read their layers for ranges or moments first and again for the result.
READ_TWICE = ("vat", "red_relief", "pca")


def batch(
    cells: DataFrame, cellsize: float, names: tuple[str, ...] = tuple(BATCH), radius: int = 10, trend: int = 20, windows: tuple[int, int, int] = (5, 50, 500),
    vat_radii: tuple[int, int] = (50, 50), e4mstp_settings: dict | None = None,
) -> DataFrame:
    """(r, c, the columns of each product): any products from one plan of their shared layers.

    Products say which layers they need; a layer that several need is made once.
    All ray layers share one scan of the tiles, all layers of gradients one pass,
    all windows two shuffles.  The layers are joined and, if a product reads them
    for their ranges first, written once; all ranges come from one aggregate.
    """
    if unknown := set(names) - set(BATCH):
        raise ValueError(f"Unknown visualisation: {min(unknown)}")
    if foreign := set(e4mstp_settings or {}) - set(E4MSTP):
        raise ValueError(f"Unknown setting: {min(foreign)}")
    wants = lambda *k: any(n in names for n in k)
    e4 = {**E4MSTP, **(e4mstp_settings or {})}
    s = grid_stats(cells)

    rays: dict[str, tuple[str, dict]] = {}

    def ray(kind: str, **given) -> str:
        """The column of a ray layer; the same layer asked for twice is one."""
        same = [n for n, layer in rays.items() if layer == (kind, given)]
        name = same[0] if same else f"ray_{len(rays)}"
        rays[name] = (kind, given)
        return name

    way = {"directions": 16}
    ring = {"min_radius": 10.0, "max_radius": 20.0, "angle": 15.0, "observer": 1.7}
    plain = {"svf": ("svf", {"radius": radius, **way}), "asvf": ("asvf", {"radius": radius, **way}), "openness": ("openness", {"radius": radius, **way}), "local_dominance": ("local_dominance", ring)}
    of = {n: ray(kind, **given) for n, (kind, given) in plain.items() if n in names or ("pca" in names and n != "asvf")}
    if "vat" in names:
        of |= {"vat_svf": ray("svf", radius=vat_radii[0], **way), "vat_opn": ray("openness", radius=vat_radii[1], **way)}
    if "e4mstp" in names:
        of |= {n: ray(kind, **given) for n, (kind, given) in _e4mstp_rays(e4).items()}
    radii = {*(windows if "mstp" in names else ()), *(e4["windows"] if "e4mstp" in names else ())}
    if "mstp" in names:
        stencil.check_windows(*windows)
    if "e4mstp" in names:
        stencil.check_windows(*e4["windows"])

    parts = []
    if wants("slope", "hillshade", "vat", "red_relief", "pca", "e4mstp"):
        shades = lambda suns: sum((stencil.shade_of(a, 45.0) for a in suns), F.lit(0.0)) / len(suns) * 255.0
        near = {"slope": stencil.slope_of()} if wants("slope", "vat", "red_relief", "pca", "e4mstp") else {}
        near |= {"hillshade": shades(stencil.DEFAULT_AZIMUTHS)} if "hillshade" in names else {}
        near |= {"shade": shades((315.0, 45.0, 135.0, 225.0))} if "vat" in names else {}
        parts.append(stencil.gradients(cells, cellsize, stats=s).select("r", "c", *[F.when(F.col("z").isNotNull(), v).alias(n) for n, v in near.items()]))
    if rays:
        parts.append(horizon.layers(cells, cellsize, rays, stats=s))
    if wants("slrm", "red_relief"):
        parts.append(stencil.local_relief(cells, trend, s))
    if radii:
        parts.append(stencil.deviations(stencil.filled(cells, s), {f"dev_{k}": k for k in sorted(radii)}, s))
    d = aligned(*parts)
    if wants(*READ_TWICE):
        d = cut(d)
    ranged = [*(("shade", "slope", of["vat_opn"], of["vat_svf"]) if "vat" in names else ()), *(("slrm", "slope") if "red_relief" in names else ())]
    e = extremes(d, *dict.fromkeys(ranged)) if ranged else {}

    added = {n: F.col(of[n]) for n in ("svf", "asvf", "openness", "local_dominance") if n in names}
    if "mstp" in names:
        added |= {c: stencil.position_byte(F.col(f"dev_{k}")) for c, k in zip(BATCH["mstp"], reversed(windows), strict=True)}
    if "pca" in names:
        added |= dict(zip(BATCH["pca"], components(d, (of["svf"], of["openness"], "slope", of["local_dominance"])), strict=True))
    d = d.withColumns(added) if added else d
    if "vat" in names:
        d = _vat(d, e, {"shade": "shade", "slope": "slope", "opn": of["vat_opn"], "svf": of["vat_svf"]}, "vat")
    if "red_relief" in names:
        d = _red(d, e, "slrm", "slope", "red_relief")
    out = [c for n in names for c in BATCH[n]]
    if "e4mstp" in names:
        unit = lambda n: clip(F.col(of[n]) / 180.0, 0.0, 1.0)
        bands = {m: stencil.position_byte(F.col(f"dev_{k}")) / 255.0 for m, k in zip(("mstp_r", "mstp_g", "mstp_b"), reversed(e4["windows"]), strict=True)}
        scaled = {"o_pos": unit("o_pos"), "o_neg": unit("o_neg"), "ld": F.col(of["ld"]) / 255.0, "s": clip(F.col("slope") / 90.0, 0.0, 1.0), "svf_s": F.col(of["svf_s"]), "svf_l": F.col(of["svf_l"]), **bands}
        kept = tuple(c for c in out if c not in BATCH["e4mstp"])
        d = e4mstp(d.withColumns(scaled), kept, BATCH["e4mstp"])
    return d.select("r", "c", *out)
