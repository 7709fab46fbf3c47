"""DuckDB SQL of the neighbourhood operators, built from the same surfaces."""

from __future__ import annotations

import math
import re

from tellurian.sources.surfaces import ctes

_CELLS = ", m AS (SELECT avg(z) AS mean, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM {t}), f AS MATERIALIZED (SELECT r, c, z, coalesce(z, mean) AS f FROM {t}, m)"


def gradient(surface: str, select: str, central: bool = False) -> str:
    """``select`` over r, c, z, f, dx, dy and steep; null where z is."""
    rows = "SELECT r, c, z, f, coalesce(lag(f) OVER w, f) AS w, coalesce(lead(f) OVER w, f) AS e FROM f WINDOW w AS (PARTITION BY r ORDER BY c)"
    both = "SELECT r, c, z, f, w, e, " + ", ".join(f"coalesce({fn}({n}) OVER v, {n}) AS {n}{side}" for n in ("f", "w", "e") for side, fn in (("n", "lag"), ("s", "lead"))) + f" FROM ({rows}) WINDOW v AS (PARTITION BY c ORDER BY r)"
    if central:
        dx, dy = "(e - w) / 2.0::DOUBLE", "(fs - fn) / 2.0::DOUBLE"
    else:
        dx, dy = "((en + 2 * e + es) - (wn + 2 * w + ws)) / 8.0::DOUBLE", "((ws + 2 * fs + es) - (wn + 2 * fn + en)) / 8.0::DOUBLE"
    expr, name = select.rsplit(" AS ", 1)
    return ctes(surface) + _CELLS.format(t=surface) + f", g AS (SELECT *, sqrt(dx * dx + dy * dy) AS steep FROM (SELECT *, {dx} AS dx, {dy} AS dy FROM ({both}))) SELECT r, c, CASE WHEN z IS NOT NULL THEN {expr} END AS {name} FROM g"


def shade(azimuth: float, altitude: float) -> str:
    sun, zenith = 450.0 - azimuth % 360.0, 90.0 - altitude
    return f"greatest(least(cos(atan(steep)) * cos(radians({zenith}::DOUBLE)) + sin(atan(steep)) * sin(radians({zenith}::DOUBLE)) * cos(radians({sun}::DOUBLE) - atan2(-dy, dx)), 1.0::DOUBLE), 0.0::DOUBLE)"


RUGGEDNESS = (
    ctes("sparse")
    + """, n AS (SELECT a.r, a.c, a.z, sum(pow(b.z - a.z, 2)) AS s FROM sparse a LEFT JOIN sparse b
        ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (b.r, b.c) <> (a.r, a.c) GROUP BY a.r, a.c, a.z),
    g AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM sparse),
    e AS (SELECT n.*, coalesce(k.extra, 0) AS extra FROM n LEFT JOIN (
        SELECT a.r, a.c, sum(pow(b.z - a.z, 2)) AS extra FROM sparse a, g, (VALUES (-1), (0), (1)) p(i), (VALUES (-1), (0), (1)) q(j), sparse b
        WHERE NOT (i = 0 AND j = 0) AND (a.r + i < r0 OR a.r + i > r1 OR a.c + j < c0 OR a.c + j > c1)
          AND b.r = greatest(least(a.r + i, r1), r0) AND b.c = greatest(least(a.c + j, c1), c0) GROUP BY a.r, a.c) k ON k.r = n.r AND k.c = n.c)
    SELECT r, c, round(CASE WHEN z IS NOT NULL THEN sqrt(coalesce(s, 0) + extra) END, 6) AS tri FROM e"""
)


def _mirror(table: str, axis: str, radius: int, low: str, high: str) -> str:
    n = f"({high} - {low} + 1)"
    other = "c" if axis == "r" else "r"
    return f"""(SELECT {other}, v, unnest(list_filter(flatten([[k * 2 * {n} + {axis} - {low}, k * 2 * {n} - 1 - ({axis} - {low})] FOR k IN range(-3, 4)]), lambda x: x >= -{radius} AND x < {n} + {radius})) + {low} AS {axis}
        FROM {table}, m)"""


def local_relief(surface: str, radius: int) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + f""", v0 AS (SELECT r, c, f AS v FROM f),
    v1 AS (SELECT r, c, v FROM (SELECT r, c, avg(v) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {_mirror("v0", "r", radius, "r0", "r1")}), m WHERE r BETWEEN r0 AND r1),
    v2 AS (SELECT r, c, v FROM (SELECT r, c, avg(v) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS v FROM {_mirror("v1", "c", radius, "c0", "c1")}), m WHERE c BETWEEN c0 AND c1)
    SELECT f.r, f.c::INT AS c, round(CASE WHEN z IS NOT NULL THEN f - v END, 6) AS slrm FROM f JOIN v2 ON v2.r = f.r AND v2.c = f.c"""


def _deviation(radius: int, name: str) -> str:
    frame = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f""", {name}_h AS (SELECT r, c, f, sum(f) OVER w AS s1, sum(f * f) OVER w AS s2, count(*) OVER w AS n FROM f WINDOW w AS (PARTITION BY r ORDER BY c {frame})),
    {name}_v AS (SELECT r, c, f, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2, sum(n) OVER w AS n FROM {name}_h WINDOW w AS (PARTITION BY c ORDER BY r {frame})),
    {name} AS MATERIALIZED (SELECT r, c, CASE WHEN sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) < 0.001 THEN 0 ELSE (f - s1 / n) / sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0)) END AS d FROM {name}_v)"""


def deviation(surface: str, radius: int) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _deviation(radius, "d5") + " SELECT r, c, round(d, 5) AS dev FROM d5"


def _position(local: int, meso: int, broad: int) -> str:
    byte = lambda t: f"CASE WHEN f.z IS NULL THEN 0 ELSE trunc(greatest(least(127 + {t}.d * 50.0::DOUBLE, 255.0::DOUBLE), 0.0::DOUBLE))::INT END"
    return _deviation(broad, "dr") + _deviation(meso, "dg") + _deviation(local, "db") + f""", pos AS MATERIALIZED (SELECT f.r, f.c, {byte("dr")} AS red, {byte("dg")} AS green, {byte("db")} AS blue
        FROM f JOIN dr ON dr.r = f.r AND dr.c = f.c JOIN dg ON dg.r = f.r AND dg.c = f.c JOIN db ON db.r = f.r AND db.c = f.c)"""


def mstp(surface: str, local: int, meso: int, broad: int) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _position(local, meso, broad) + " SELECT * FROM pos"


def ray_samples(directions: int, radius: int) -> str:
    """(k, dr, dc, dist): samples at every third of a cell from distance 1 on, each cell with the first that falls into it."""
    turn = f"(2 * pi() / {directions} * k.range)"
    return f"""SELECT k, dr, dc, min(s) AS dist FROM (SELECT k.range AS k, round_even(-cos({turn}) * s, 0)::BIGINT AS dr, round_even(sin({turn}) * s, 0)::BIGINT AS dc, s
        FROM range({directions}) k, (SELECT 1 + i.range / 3.0::DOUBLE AS s FROM range({(radius - 1) * 3 + 1}) i)) WHERE dr <> 0 OR dc <> 0 GROUP BY k, dr, dc"""


def ring_samples(low: float, high: float, step: float, angle: float) -> str:
    """(dr, dc, dist): a sample for every radius from ``low`` to ``high`` in each of the evenly spaced directions."""
    turn = f"(2 * pi() * t.range / ceil(360 / {angle}::DOUBLE))"
    radii = f"(SELECT {low}::DOUBLE + i.range * {step}::DOUBLE AS dist FROM range(ceil(({high}::DOUBLE + {step}::DOUBLE - {low}::DOUBLE) / {step}::DOUBLE)::BIGINT) i)"
    return f"SELECT round_even(-dist * cos({turn}), 0)::BIGINT AS dr, round_even(dist * sin({turn}), 0)::BIGINT AS dc, dist FROM range(ceil(360 / {angle}::DOUBLE)::BIGINT) t, {radii} WHERE dist > 0"


#: An anisotropic horizon is confirmed by a sample that falls short of it by the sine of two degrees at most.
_SLACK = math.sin(math.radians(2))


def _tops(name: str, directions: int, radius: int, floor: float, sign: int = 1) -> str:
    """name(r, c, k, top): the highest sine along each ray."""
    return f""", {name} AS MATERIALIZED (SELECT a.r, a.c, k, greatest(max({sign} * (coalesce(b.f, mean) - a.f) / sqrt((coalesce(b.f, mean) - a.f) * (coalesce(b.f, mean) - a.f) + dist * dist)), {floor}::DOUBLE) AS top
        FROM f a CROSS JOIN m CROSS JOIN ({ray_samples(directions, radius)}) o(k, dr, dc, dist) LEFT JOIN f b ON b.r = a.r - dr AND b.c = a.c - dc GROUP BY a.r, a.c, k)"""


def sky_view(surface: str, directions: int, radius: int) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _tops("t", directions, radius, 0.0) + " SELECT t.r, t.c, CASE WHEN first(f.z) IS NOT NULL THEN round(1 - avg(top), 6) END AS svf FROM t JOIN f ON f.r = t.r AND f.c = t.c GROUP BY t.r, t.c"


def anisotropic(surface: str, directions: int, radius: int, azimuth: float, weight: float) -> str:
    w = f"(1 + {weight}::DOUBLE * cos(2 * pi() * k / {directions} - radians({azimuth}::DOUBLE)))"
    return ctes(surface) + _CELLS.format(t=surface) + _tops("t", directions, radius, 0.0) + f" SELECT t.r, t.c, round(sum({w} * (1 - top)) / sum({w}), 6) AS asvf FROM t GROUP BY t.r, t.c"


def _settled(name: str, directions: int, radius: int, ahead: int, slack: float) -> str:
    """name(r, c, k, top): the horizon along each ray that single spikes do not make, by a walk over its samples."""
    samples = f"SELECT k, row_number() OVER (PARTITION BY k ORDER BY dist) - 1, dr, dc, dist FROM ({ray_samples(directions, radius)})"
    dz = "(coalesce(b.f, mean) - a.f)"
    return f""", {name}_s AS MATERIALIZED (SELECT *, max(s) OVER (PARTITION BY r, c, k ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {ahead} FOLLOWING) AS behind, count(*) OVER (PARTITION BY r, c, k) AS n FROM (
        SELECT a.r, a.c, k, i, {dz} / sqrt({dz} * {dz} + dist * dist) AS s FROM f a CROSS JOIN m CROSS JOIN ({samples}) o(k, i, dr, dc, dist) LEFT JOIN f b ON b.r = a.r - dr AND b.c = a.c - dc)),
    {name}_w(r, c, k, i, n, top, resume) AS (SELECT DISTINCT r, c, k, 0, n, 0.0::DOUBLE, 0 FROM {name}_s UNION ALL
        SELECT w.r, w.c, w.k, w.i + 1, w.n, CASE WHEN s > top AND resume <= w.i AND (w.i + {ahead} >= w.n OR behind >= s - {slack!r}::DOUBLE) THEN s ELSE top END,
            CASE WHEN s > top AND resume <= w.i AND NOT (w.i + {ahead} >= w.n OR coalesce(behind >= s - {slack!r}::DOUBLE, false)) THEN w.i + {ahead} + 1 ELSE resume END
        FROM {name}_w w JOIN {name}_s s ON s.r = w.r AND s.c = w.c AND s.k = w.k AND s.i = w.i),
    {name} AS MATERIALIZED (SELECT r, c, k, top FROM {name}_w WHERE i = n)"""


def sky_view_noise(surface: str, directions: int, radius: int, noise: int) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _settled("t", directions, radius, noise, 0.0) + " SELECT t.r, t.c, round(1 - avg(top), 6) AS svf FROM t GROUP BY t.r, t.c"


def anisotropic_noise(surface: str, directions: int, radius: int, azimuth: float, weight: float, noise: int) -> str:
    w = f"(1 + {weight}::DOUBLE * cos(2 * pi() * k / {directions} - radians({azimuth}::DOUBLE)))"
    return ctes(surface) + _CELLS.format(t=surface) + _settled("t", directions, radius, noise - 1, _SLACK) + f" SELECT t.r, t.c, round(sum({w} * (1 - top)) / sum({w}), 6) AS asvf FROM t GROUP BY t.r, t.c"


def openness(surface: str, directions: int, radius: int, negative: bool) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _tops("t", directions, radius, -1.0, -1 if negative else 1) + " SELECT r, c, round(degrees(avg(pi() / 2 - asin(least(top, 1)))), 6) AS openness FROM t GROUP BY r, c"


def _dominance(name: str, low: float, high: float, step: float, angle: float, observer: float) -> str:
    values = ring_samples(low, high, step, angle)
    return f""", {name}_q AS MATERIALIZED (SELECT r, c, z, greatest(least(r + dr, r1), r0) AS r2, greatest(least(c + dc, c1), c0) AS c2, dist FROM f, m, ({values}) o(dr, dc, dist)),
    {name} AS MATERIALIZED (SELECT q.r, q.c, degrees(avg(atan((q.z + {observer}::DOUBLE - b.z) / dist))) AS v FROM {name}_q q JOIN f b ON b.r = q.r2 AND b.c = q.c2 GROUP BY q.r, q.c)"""


def dominance(surface: str, low: float, high: float, step: float, angle: float, observer: float) -> str:
    return ctes(surface) + _CELLS.format(t=surface) + _dominance("ld", low, high, step, angle, observer) + " SELECT r, c, round(v, 6) AS local_dominance FROM ld"


_MODE = {
    "multiply": "{a} * {b}",
    "screen": "1 - (1 - {a}) * (1 - {b})",
    "overlay": "CASE WHEN {a} < 0.5 THEN 2 * {a} * {b} ELSE 1 - 2 * (1 - {a}) * (1 - {b}) END",
    "soft_light": "(1 - 2 * {b}) * {a} * {a} + 2 * {b} * {a}",
}


def _blend(a: str, b: str, mode: str, opacity: float) -> str:
    x, y = (f"greatest(least(({v}) / 255.0::DOUBLE, 1), 0)" for v in (a, b))
    return f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN greatest(least(({opacity}::DOUBLE * ({_MODE[mode].format(a=x, b=y)}) + {1 - opacity}::DOUBLE * {x}) * 255.0::DOUBLE, 255), 0) END"


def blend_pair(mode: str, opacity: float) -> str:
    return ctes("dem_new") + ", p AS (SELECT r, c, z * 3 + 128 AS a, CASE WHEN (r + c) % 17 <> 0 THEN 255 - abs(z) * 4 END AS b FROM dem_new)" + f" SELECT r, c, round({_blend('a', 'b', mode, opacity)}, 6) AS v FROM p"


def _near(select: str) -> str:
    """g(r, c, z, steep, dx, dy) continued from _CELLS, then ``select``."""
    whole = gradient("dem", "0 AS x")
    return ", g AS MATERIALIZED (" + whole.split(", g AS (", 1)[1].rsplit(") SELECT r, c, CASE", 1)[0] + ")" + select


def vat(surface: str, svf_radius: int, open_radius: int) -> str:
    shades = " + ".join(shade(a, 45) for a in (315, 45, 135, 225))
    head = ctes(surface) + _CELLS.format(t=surface) + _tops("ts", 16, svf_radius, 0.0) + _tops("tp", 16, open_radius, -1.0) + _near("")
    unit = lambda n: f"({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) * 255.0::DOUBLE"
    body = f""", sv AS (SELECT r, c, 1 - avg(top) AS svf FROM ts GROUP BY r, c), op AS (SELECT r, c, degrees(avg(pi() / 2 - asin(least(top, 1)))) AS opn FROM tp GROUP BY r, c),
    l AS (SELECT g.r, g.c, ({shades}) / 4 * 255.0::DOUBLE AS shade, degrees(atan(steep)) AS slope, svf, opn FROM g JOIN sv ON sv.r = g.r AND sv.c = g.c JOIN op ON op.r = g.r AND op.c = g.c),
    u AS (SELECT r, c, {unit("shade")} AS a, 255.0::DOUBLE - {unit("slope")} AS b, {unit("opn")} AS o, {unit("svf")} AS s FROM l),
    b1 AS (SELECT *, {_blend("a", "b", "multiply", 0.5)} AS x FROM u), b2 AS (SELECT *, {_blend("x", "o", "overlay", 0.5)} AS y FROM b1)
    SELECT r, c, round({_blend("y", "s", "multiply", 0.5)}, 4) AS vat FROM b2"""
    return head + body


def red_relief(surface: str, radius: int) -> str:
    relief = local_relief(surface, radius).rsplit("SELECT f.r", 1)[0]
    unit = lambda n: f"({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) * 255.0::DOUBLE"
    return relief.rstrip() + _near("") + f""", l AS (SELECT g.r, g.c, g.f - v AS slrm, degrees(atan(steep)) AS slope FROM g JOIN v2 ON v2.r = g.r AND v2.c = g.c),
    u AS (SELECT r, c, {unit("slrm")} AS a, 255.0::DOUBLE - {unit("slope")} AS b FROM l) SELECT r, c, round({_blend("a", "b", "multiply", 0.5)}, 6) AS red_relief FROM u"""


def e4mstp(surface: str) -> str:
    head = ctes(surface) + _CELLS.format(t=surface) + _tops("ts", 16, 10, 0.0) + _tops("tl", 16, 50, 0.0) + _tops("tp", 16, 10, -1.0) + _tops("tn", 16, 10, -1.0, -1)
    head += _dominance("ld", 10.0, 20.0, 1.0, 15.0, 1.7) + _position(3, 20, 100) + _near("")
    sky = lambda n, low: f"greatest(least(({n} - {low}::DOUBLE) / (1 - {low}::DOUBLE), 1), 0)"
    mean = lambda t, n, e: f"{n} AS MATERIALIZED (SELECT r, c, {e} AS v FROM {t} GROUP BY r, c)"
    opn = "greatest(least(degrees(avg(pi() / 2 - asin(least(top, 1)))) / 180, 1), 0)"
    under = lambda base: f"(0.25::DOUBLE * ({base}) * sky + 0.75::DOUBLE * ({base}))"
    over = lambda u, p: f"trunc(greatest(least((0.9::DOUBLE * ({_MODE['overlay'].format(a=u, b=f'({p} / 255.0::DOUBLE)')}) + 0.1::DOUBLE * {u}) * 255.0::DOUBLE, 255), 0))::INT"
    return head + f""", {mean("ts", "a", "1 - avg(top)")}, {mean("tl", "b", "1 - avg(top)")}, {mean("tp", "p", opn)}, {mean("tn", "n", opn)},
    l AS (SELECT g.r, g.c, greatest(least(degrees(atan(steep)) / 90, 1), 0) AS s, p.v * n.v * (ld.v / 255) AS tex, ({sky("b.v", 0.9)} + {sky("a.v", 0.7)} * 0.5::DOUBLE) / 1.5::DOUBLE AS sky, pos.red, pos.green, pos.blue
        FROM g JOIN a ON a.r = g.r AND a.c = g.c JOIN b ON b.r = g.r AND b.c = g.c JOIN p ON p.r = g.r AND p.c = g.c JOIN n ON n.r = g.r AND n.c = g.c JOIN ld ON ld.r = g.r AND ld.c = g.c JOIN pos ON pos.r = g.r AND pos.c = g.c),
    w AS (SELECT r, c, red, green, blue, {under("s")} AS ur, {under("tex * (1 - s)")} AS ug FROM l)
    SELECT r, c, {over("ur", "red")} AS red, {over("ug", "green")} AS green, {over("ug", "blue")} AS blue FROM w"""


def fusion(layer: str, bands: tuple[str, ...], mode: str, opacity: float) -> str:
    relief = {
        "svf": sky_view("band_dem", 16, 10), "local_dominance": dominance("band_dem", 10.0, 20.0, 1.0, 15.0, 1.7),
        "slope": gradient("band_dem", "degrees(atan(steep)) AS slope"), "slrm": local_relief("band_dem", 20),
    }[layer]
    unit = lambda n: f"({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ())"
    mix = "{a} * (1 - {o}) + {a} * {b} * {o}" if mode == "luminance_overlay" else "(1 - {o}) * {b} + {o} * (" + _MODE.get(mode, "") + ")"
    byte = lambda b: f"trunc(greatest(least(({mix.format(a='a', b=b, o=f'{opacity}::DOUBLE')}) * 255.0::DOUBLE, 255), 0))::INT"
    # The layer itself, not its rounded form.
    for rounded, whole in (("round(1 - avg(top), 6)", "1 - avg(top)"), ("round(v, 6)", "v"), ("round(CASE WHEN z IS NOT NULL THEN f - v END, 6)", "CASE WHEN z IS NOT NULL THEN f - v END")):
        relief = relief.replace(rounded, whole)
    return ctes("spectral") + f""", u AS (SELECT r, c, {unit(layer)} AS a, {unit(bands[0])} AS x, {unit(bands[1])} AS y, {unit(bands[2])} AS w FROM spectral JOIN ({relief}) USING (r, c))
    SELECT r, c, {byte("x")} AS red, {byte("y")} AS green, {byte("w")} AS blue FROM u"""


#: Weight of a source cell at distance t, in SQL.
_KERNELS = {
    "bilinear": ("greatest(1 - t, 0)", 1),
    "cubic": ("CASE WHEN t < 1 THEN 1.5::DOUBLE * t ** 3 - 2.5::DOUBLE * t ** 2 + 1 WHEN t < 2 THEN -0.5::DOUBLE * t ** 3 + 2.5::DOUBLE * t ** 2 - 4 * t + 2 ELSE 0 END", 2),
    "cubic_spline": ("CASE WHEN t < 1 THEN (4 - 6 * t ** 2 + 3 * t ** 3) / 6 WHEN t < 2 THEN (2 - t) ** 3 / 6 ELSE 0 END", 2),
    "lanczos": ("CASE WHEN t < 1e-9 THEN 1 WHEN t < 3 THEN 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * t) ** 2 ELSE 0 END", 3),
}


def resampled(surface: str, value: str, how: str, scale: float, offset: float, size: str) -> str:
    """``size`` gives rows and cols of the target from g.rows and g.cols."""
    kernel, reach = _KERNELS[how]
    far, wide = math.ceil(reach * max(1.0, scale)), max(1.0, scale)
    taps = f"(SELECT range + {1 - far} AS d FROM range({2 * far}))"
    weigh = lambda at, d: re.sub(r"\bt\b", f"(abs(floor({at}) + {d} - {at}) / {wide}::DOUBLE)", f"({kernel})")
    return ctes(surface) + f""", g AS (SELECT {size} FROM (SELECT max(r) + 1 AS rows, max(c) + 1 AS cols FROM {surface})),
    t AS (SELECT i.range AS r, j.range::INT AS c, i.range * {scale}::DOUBLE + {offset}::DOUBLE AS y, j.range * {scale}::DOUBLE + {offset}::DOUBLE AS x FROM g, range(g.rows) i, range(g.cols) j),
    k AS (SELECT r, c, (floor(y) + a.d)::BIGINT AS sr, (floor(x) + b.d)::BIGINT AS sc, {weigh("y", "a.d")} * {weigh("x", "b.d")} AS w, floor(y) + a.d = floor(y + 0.5::DOUBLE) AND floor(x) + b.d = floor(x + 0.5::DOUBLE) AS under FROM t, {taps} a, {taps} b)
    SELECT k.r, k.c, round(CASE WHEN bool_or(under AND s.{value} IS NOT NULL) THEN sum(w * s.{value}) / sum(w) FILTER (s.{value} IS NOT NULL) END, 6) AS z FROM k LEFT JOIN {surface} s ON s.r = k.sr AND s.c = k.sc GROUP BY k.r, k.c"""


def joined(*parts: str) -> str:
    """Several layers over the same cells side by side."""
    return "SELECT * FROM " + " JOIN ".join(f"({p}) t{i}" + (" USING (r, c)" if i else "") for i, p in enumerate(parts))


def _outline(side: str) -> str:
    line, at = ("r", "c") if side in "ns" else ("c", "r")
    lower = f"{line}_{' + 1' if side in 'se' else ''}"
    ends = {"n": ("b", lower, "a", lower), "s": ("a", lower, "b", lower), "w": (lower, "a", lower, "b"), "e": (lower, "b", lower, "a")}[side]
    return f"""SELECT label, {', '.join(f'({e})::BIGINT AS {n}' for e, n in zip(ends, ('x1', 'y1', 'x2', 'y2'), strict=True))} FROM (SELECT label, {line} AS {line}_, min({at}) AS a, max({at}) + 1 AS b FROM (
        SELECT label, {line}, {at}, {at} - row_number() OVER (PARTITION BY label, {line} ORDER BY {at}) AS g FROM near WHERE label <> 0 AND {side} IS DISTINCT FROM label) GROUP BY label, {line}, g)"""


OUTLINES = (
    ctes("labels_at") + """, near AS (SELECT r, c, label, lag(label) OVER h AS w, lead(label) OVER h AS e, lag(label) OVER v AS n, lead(label) OVER v AS s FROM labels_at WINDOW h AS (PARTITION BY r ORDER BY c), v AS (PARTITION BY c ORDER BY r)) """
    + " UNION ALL ".join(map(_outline, "nswe"))
)
_GRID = """, e AS (SELECT min(x) - 1 AS left_x, max(y) + 1 AS top_y, trunc((max(x) - min(x) + 2) / 2)::BIGINT + 1 AS cols, trunc((max(y) - min(y) + 2) / 2)::BIGINT + 1 AS rows FROM cloud)"""
IDW = (
    ctes("cloud") + _GRID + """, g AS (SELECT i.range AS r, j.range::INT AS c, left_x + (j.range + 0.5::DOUBLE) * 2 AS cx, top_y - (i.range + 0.5::DOUBLE) * 2 AS cy FROM e, range(e.rows) i, range(e.cols) j),
    n AS (SELECT g.r, g.c, z, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2, row_number() OVER (PARTITION BY g.r, g.c ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), z, x, y) AS nth
        FROM g JOIN cloud ON x BETWEEN cx - 10 AND cx + 10 AND y BETWEEN cy - 10 AND cy + 10 WHERE (x - cx) * (x - cx) + (y - cy) * (y - cy) <= 100)
    SELECT g.r, g.c, round(sum(n.z / (d2 + 1)) / sum(1 / (d2 + 1)), 5) AS z FROM g LEFT JOIN n ON n.r = g.r AND n.c = g.c AND nth <= 12 GROUP BY g.r, g.c"""
)
#: Neighbours within 4 first; the few points that have less than eight there are compared with all.
OUTLIERS = (
    ctes("cloud") + """, near AS MATERIALIZED (SELECT id, d FROM (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d
        FROM cloud a JOIN cloud b ON b.x BETWEEN a.x - 4 AND a.x + 4 AND b.y BETWEEN a.y - 4 AND a.y + 4 AND a.id <> b.id) WHERE d <= 4),
    sparse AS MATERIALIZED (SELECT c.* FROM cloud c LEFT JOIN (SELECT id, count(*) AS n FROM near GROUP BY id) k ON k.id = c.id WHERE coalesce(n, 0) < 8),
    far AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM sparse a JOIN cloud b ON a.id <> b.id),
    n AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS nth FROM (SELECT * FROM near WHERE id NOT IN (SELECT id FROM sparse) UNION ALL SELECT * FROM far)),
    m AS (SELECT id, avg(d) AS mean_distance FROM n WHERE nth <= 8 GROUP BY id), l AS (SELECT avg(mean_distance) + 2 * stddev_samp(mean_distance) AS most FROM m)
    SELECT c.id, round(mean_distance, 6) AS mean_distance, mean_distance IS NULL OR mean_distance > most AS is_outlier FROM cloud c CROSS JOIN l LEFT JOIN m ON m.id = c.id"""
)


def _open(source: str, value: str, half: int, out: str) -> str:
    frame = f"RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    rest = "" if value == "z" else ", z, ground, s"
    steps, at = [], value
    for i, (f, other, axis) in enumerate((("min", "r", "c"), ("min", "c", "r"), ("max", "r", "c"), ("max", "c", "r"))):
        steps.append(f"{out}{i} AS (SELECT r, c{rest}, {f}({at}) OVER (PARTITION BY {other} ORDER BY {axis} {frame}) AS o FROM {source if i == 0 else f'{out}{i - 1}'})")
        at = "o"
    return ", ".join(steps)


_LOW = ", low AS (SELECT floor(y)::BIGINT AS r, floor(x)::INT AS c, min(z) AS z FROM cloud GROUP BY ALL)"
OPENING = ctes("cloud") + _LOW + ", " + _open("low", "z", 2, "q") + " SELECT r, c, round(o, 6) AS opened FROM q3"


def pmf() -> str:
    sql, half, before, k = ctes("cloud") + _LOW + ", s0 AS (SELECT r, c, z, true AS ground, z AS s FROM low)", 1, 0, 0
    while 2 * half + 1 <= 33:
        limit = 0.3 if k == 0 else min(1.0, 0.25 * 2 * (half - before) + 0.3)
        sql += ", " + _open(f"s{k}", "s", half, f"w{k}_") + f", s{k + 1} AS (SELECT r, c, z, ground AND s - o <= {limit}::DOUBLE AS ground, o AS s FROM w{k}_3)"
        before, half, k = half, half * 2, k + 1
    return sql + f" SELECT id FROM cloud JOIN s{k} s ON s.r = floor(y) AND s.c = floor(x) WHERE s.ground AND cloud.z - s.s <= 1.0"


_OVERLAP = """CASE WHEN least(a.x2, b.x2) < greatest(a.x1, b.x1) OR least(a.y2, b.y2) < greatest(a.y1, b.y1) THEN 0 ELSE
    (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) -
    (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) END"""
SUPPRESSION = (
    ctes("boxes") + f""", k AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, id) AS rank FROM boxes WHERE confidence >= 0.5),
    pairs AS (SELECT a.rank AS strong, b.rank AS weak FROM k a JOIN k b ON a.class_id = b.class_id AND a.rank < b.rank AND {_OVERLAP} >= 0.45),
    walk(rank, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT w.rank + 1, CASE WHEN list_contains(w.gone, w.rank + 1) THEN w.gone ELSE w.gone || coalesce((SELECT list(weak) FROM pairs WHERE strong = w.rank + 1), []::BIGINT[]) END
        FROM walk w WHERE w.rank < (SELECT max(rank) FROM k))
    SELECT id, class_id FROM k WHERE NOT list_contains((SELECT gone FROM walk ORDER BY rank DESC LIMIT 1), rank)"""
)
POLYGONS = (
    ctes("labels_at") + """, runs AS (SELECT r, label, min(c) AS first, max(c) AS last, row_number() OVER (ORDER BY r, min(c)) AS run FROM (
        SELECT r, c, label, c - row_number() OVER (PARTITION BY r, label ORDER BY c) AS g FROM labels_at WHERE label <> 0) GROUP BY r, label, g),
    links AS (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON b.r = a.r + 1 AND b.label = a.label AND a.first <= b.last AND b.first <= a.last),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(run, root) AS (SELECT run, run FROM runs UNION SELECT l.b, reach.root FROM reach JOIN both_ways l ON l.a = reach.run WHERE l.b > reach.root),
    roots AS (SELECT run, min(root) AS root FROM reach GROUP BY run),
    regions AS (SELECT root, label AS class_id, sum(last - first + 1)::BIGINT AS cell_count, min(r) AS min_r, max(r) AS max_r, min(first) AS min_c, max(last) AS max_c FROM runs JOIN roots USING (run) GROUP BY root, label)
    SELECT class_id, cell_count, cell_count::DOUBLE AS area, min_r, max_r, min_c, max_c, (SELECT round(avg(confidence), 6) FROM labels_at WHERE label = class_id) AS mean_confidence FROM regions WHERE cell_count >= 10"""
)


def ground_grid() -> str:
    """IDW over the points that the progressive filter keeps."""
    filtered = pmf().replace("SELECT id FROM cloud JOIN", "SELECT cloud.* FROM cloud JOIN")
    head, tail = filtered.rsplit(" SELECT cloud.* FROM cloud JOIN", 1)
    body = IDW[len(ctes("cloud")) :].replace("cloud", "kept")
    return head + f", kept AS (SELECT cloud.* FROM cloud JOIN{tail})" + body

#: Regions by closure over row runs, unit sides merged into stretches, rings by walking on from every stretch while no earlier one is met.
SEGMENT_SHAPES = (
    ctes("dem") + """, lab AS MATERIALIZED (SELECT r, c, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN 2 END AS label FROM dem WHERE z > 1 OR z < -1),
    runs AS MATERIALIZED (SELECT r, label, min(c)::BIGINT AS first, max(c)::BIGINT AS last, r * 100000 + min(c) AS run FROM (
        SELECT r, c, label, c - row_number() OVER (PARTITION BY r, label ORDER BY c) AS g FROM lab) GROUP BY r, label, g),
    links AS MATERIALIZED (SELECT a.run AS a, b.run AS b FROM runs a JOIN runs b ON abs(b.r - a.r) = 1 AND b.label = a.label AND a.first <= b.last AND b.first <= a.last),
    near(run, other) AS (SELECT run, run FROM runs UNION SELECT n.run, l.b FROM near n JOIN links l ON l.a = n.other),
    roots AS MATERIALIZED (SELECT run, min(other) AS region FROM near GROUP BY run),
    big AS MATERIALIZED (SELECT region, any_value(label) AS class_id, sum(last - first + 1)::BIGINT AS cell_count FROM runs JOIN roots USING (run) GROUP BY region HAVING sum(last - first + 1) >= 10),
    own AS MATERIALIZED (SELECT lab.r, lab.c, k.region FROM lab JOIN runs u ON u.r = lab.r AND lab.c BETWEEN u.first AND u.last JOIN roots k USING (run) JOIN big USING (region)),
    sides AS (
        SELECT region, 0 AS d, c::BIGINT AS line, r AS p FROM own o WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.region = o.region AND x.r = o.r AND x.c = o.c - 1)
        UNION ALL SELECT region, 1, r + 1, c FROM own o WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.region = o.region AND x.r = o.r + 1 AND x.c = o.c)
        UNION ALL SELECT region, 2, c + 1, r FROM own o WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.region = o.region AND x.r = o.r AND x.c = o.c + 1)
        UNION ALL SELECT region, 3, r, c FROM own o WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.region = o.region AND x.r = o.r - 1 AND x.c = o.c)),
    lines AS (SELECT region, d, line, min(p) AS a, max(p) + 1 AS b FROM (SELECT *, p - row_number() OVER (PARTITION BY region, d, line ORDER BY p) AS g FROM sides) GROUP BY region, d, line, g),
    segs AS MATERIALIZED (SELECT *, y1 * 1000000 + x1 * 4 + d AS seg FROM (SELECT region, d,
        CASE d WHEN 0 THEN line WHEN 1 THEN a WHEN 2 THEN line ELSE b END AS x1, CASE d WHEN 0 THEN a WHEN 1 THEN line WHEN 2 THEN b ELSE line END AS y1,
        CASE d WHEN 0 THEN line WHEN 1 THEN b WHEN 2 THEN line ELSE a END AS x2, CASE d WHEN 0 THEN b WHEN 1 THEN line WHEN 2 THEN a ELSE line END AS y2 FROM lines)),
    succ AS MATERIALIZED (SELECT p.seg, p.region, p.x1, p.y1, p.x2, p.y2, arg_max(q.seg, ((q.d - p.d + 4) % 4 = 3)::INT) AS nxt
        FROM segs p JOIN segs q ON q.region = p.region AND q.x1 = p.x2 AND q.y1 = p.y2 GROUP BY ALL),
    walk(start, seg, nxt, step) AS (SELECT seg, seg, nxt, 0 FROM succ UNION ALL SELECT w.start, s.seg, s.nxt, w.step + 1 FROM walk w JOIN succ s ON s.seg = w.nxt WHERE w.nxt > w.start),
    rings AS (SELECT s.region, w.start, sum(s.x1 * s.y2 - s.x2 * s.y1) > 0 AS hole,
        '(' || arg_min(s.x1 || ' ' || s.y1, w.step) || ', ' || string_agg(s.x1 || ' ' || s.y1, ', ' ORDER BY w.step DESC) || ')' AS ring
        FROM walk w JOIN succ s USING (seg) WHERE w.start IN (SELECT start FROM walk WHERE nxt = start) GROUP BY s.region, w.start)
    SELECT any_value(class_id) AS class_id, any_value(cell_count) AS cell_count, count(*) - 1 AS holes, 'POLYGON (' || string_agg(ring, ', ' ORDER BY hole, start) || ')' AS wkt
    FROM rings JOIN big USING (region) GROUP BY region"""
)

_A, _F = "6378137.0::DOUBLE", "(1 / 298.257223563::DOUBLE)"
#: n, the third flattening, e, the eccentricity, and a, the radius of the quarter meridian, with Krueger's coefficients.
_KRUEGER = f"""k0 AS (SELECT {_F} / (2 - {_F}) AS n, sqrt({_F} * (2 - {_F})) AS e),
    k AS (SELECT n, e, 0.9996::DOUBLE * {_A} / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS a,
        n / 2 - pow(n, 2) * 2 / 3 + pow(n, 3) * 5 / 16 + pow(n, 4) * 41 / 180 AS a1, pow(n, 2) * 13 / 48 - pow(n, 3) * 3 / 5 + pow(n, 4) * 557 / 1440 AS a2, pow(n, 3) * 61 / 240 - pow(n, 4) * 103 / 140 AS a3, pow(n, 4) * 49561 / 161280 AS a4,
        n / 2 - pow(n, 2) * 2 / 3 + pow(n, 3) * 37 / 96 - pow(n, 4) / 360 AS b1, pow(n, 2) / 48 + pow(n, 3) / 15 - pow(n, 4) * 437 / 1440 AS b2, pow(n, 3) * 17 / 480 - pow(n, 4) * 37 / 840 AS b3, pow(n, 4) * 4397 / 161280 AS b4 FROM k0)"""


def _sum(c: str, f: str, g: str, x: str, y: str) -> str:
    return "(" + " + ".join(f"{c}{j} * {f}({2 * j} * {x}) * {g}({2 * j} * {y})" for j in range(1, 5)) + ")"


def zone_to_degrees(points: str, meridian: float) -> str:
    """CTE bodies from ``points`` (x, y and others) to ``degrees`` (lat and lon in radians); the latitude by fixed points of its definition."""
    latitude = "gd"
    for _ in range(8):
        latitude = f"atan(sinh(asinh(tan(gd)) + e * atanh(e * sin({latitude}))))"
    return f"""p1 AS (SELECT p.*, k.*, y / a AS xi, (x - 500000) / a AS eta FROM {points} p, k),
    p2 AS (SELECT *, xi - {_sum("b", "sin", "cosh", "xi", "eta")} AS u, eta - {_sum("b", "cos", "sinh", "xi", "eta")} AS v FROM p1),
    p3 AS (SELECT *, asin(sin(u) / cosh(v)) AS gd, radians({meridian}::DOUBLE) + atan2(sinh(v), cos(u)) AS lon FROM p2),
    degrees AS (SELECT *, {latitude} AS lat FROM p3)"""


def degrees_to_zone(meridian: float) -> str:
    """CTE bodies from ``degrees`` to ``placed`` (px, py)."""
    return f"""q1 AS (SELECT *, tan(lat) AS t, sinh(e * atanh(e * tan(lat) / sqrt(1 + tan(lat) * tan(lat)))) AS s, lon - radians({meridian}::DOUBLE) AS lam FROM degrees),
    q2 AS (SELECT *, t * sqrt(1 + s * s) - s * sqrt(1 + t * t) AS tt FROM q1),
    q3 AS (SELECT *, atan2(tt, cos(lam)) AS f, asinh(sin(lam) / sqrt(tt * tt + cos(lam) * cos(lam))) AS g FROM q2),
    placed AS (SELECT *, 500000 + a * (g + {_sum("a", "cos", "sinh", "f", "g")}) AS px, a * (f + {_sum("a", "sin", "cosh", "f", "g")}) AS py FROM q3)"""


REPROJECT_POINTS = (
    ctes("cloud") + f""", moved AS (SELECT id, 714900 + x * 400 AS x, 5546000 - y * 400 AS y FROM cloud), {_KRUEGER}, {zone_to_degrees("moved", 3)}, {degrees_to_zone(9)}
    SELECT id, round(degrees(lon), 7) AS lon, round(degrees(lat), 7) AS lat, round(px, 2) AS x, round(py, 2) AS y FROM placed"""
)


def reprojected_difference(old: tuple[float, ...], new: tuple[float, ...], limit: float) -> str:
    """Bilinear values of dem_new on the grid of dem, less dem."""
    return ctes("dem", "dem_new") + f""", centres AS (SELECT r, c, z, {old[0]}::DOUBLE + (c + 0.5::DOUBLE) * {old[1]} AS x, {old[2]}::DOUBLE + (r + 0.5::DOUBLE) * {old[3]} AS y FROM dem),
    {_KRUEGER}, {zone_to_degrees("centres", 3)}, {degrees_to_zone(9)},
    spot AS (SELECT r, c, z, (py - {new[2]}::DOUBLE) / {new[3]} - 0.5::DOUBLE AS sr, (px - {new[0]}::DOUBLE) / {new[1]} - 0.5::DOUBLE AS sc FROM placed),
    taps AS (SELECT a.r, a.c, any_value(a.z) AS z, sum(n.z * (1 - abs(n.r - sr)) * (1 - abs(n.c - sc))) / sum((1 - abs(n.r - sr)) * (1 - abs(n.c - sc))) AS v, bool_or(n.r = floor(sr + 0.5::DOUBLE) AND n.c = floor(sc + 0.5::DOUBLE)) AS under
        FROM (SELECT spot.*, floor(sr)::BIGINT + i.range AS tr, floor(sc)::BIGINT + j.range AS tc FROM spot, range(2) i, range(2) j) a LEFT JOIN dem_new n ON n.r = a.tr AND n.c = a.tc AND n.z IS NOT NULL GROUP BY a.r, a.c),
    d AS (SELECT r, c, CASE WHEN under THEN v END - z AS dod FROM taps)
    SELECT r, c, round(dod, 2) + 0.0::DOUBLE AS dod, CASE WHEN dod IS NULL THEN 255 WHEN dod < -{limit!r}::DOUBLE THEN 1 WHEN dod > {limit!r}::DOUBLE THEN 2 ELSE 0 END AS mask FROM d"""
