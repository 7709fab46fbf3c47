"""Names, redaction, escaping: text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Assignments to these names are secrets.
SECRET = r"(?i)\b(api[_-]?key|token|password|secret)\s*([:=])\s*([^\s,;]+)"


def redact(text: Column, home: str | None = None) -> Column:
    """Masks the values of secret assignments, and a home folder if one is given."""
    masked = F.regexp_replace(text, SECRET, "$1$2<REDACTED>")
    return F.replace(masked, F.lit(home), F.lit("<HOME>")) if home and home != "/" else masked


def safe_component(text: Column) -> Column:
    """Part of a file name: other than word characters, dots and hyphens become one underscore."""
    slug = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w.-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(slug == "", "output").otherwise(slug)


def output_name(template: str, source: Column, method: Column, preset: Column, date: Column) -> Column:
    """A GeoTIFF name from a template with {dem}, {method}, {preset} and {date}."""
    import string

    template = (template or "{dem}_{method}").strip()
    if "/" in template or "\\" in template:
        raise ValueError("A name template cannot hold folder separators")
    used = {f for _, f, _, _ in string.Formatter().parse(template) if f}
    if unknown := used - {"dem", "method", "preset", "date"}:
        raise ValueError(f"Unknown field: {min(unknown)}")
    stem = F.regexp_replace(F.regexp_replace(source, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    parts = {"dem": safe_component(stem), "method": safe_component(method), "preset": safe_component(F.when(preset == "", "manual").otherwise(F.coalesce(preset, F.lit("manual")))), "date": date}
    out = F.lit(template)
    for n, v in parts.items():
        out = F.replace(out, F.lit("{" + n + "}"), v)
    name = safe_component(out)
    return F.when(F.lower(name).endswith(".tif"), name).otherwise(F.concat(name, F.lit(".tif")))


def project_name(text: Column) -> Column:
    """A folder name without path parts; blank names become ``untitled``."""
    slug = F.regexp_replace(text, r"[^A-Za-z0-9 \-_.]", "_")
    slug = F.regexp_replace(F.ltrim(F.trim(slug), F.lit("._/\\")), r"\s+", "_")
    return F.when(text.isNull() | (slug == ""), "untitled").otherwise(slug)


def escape_html(text: Column) -> Column:
    """The five characters and their entities, the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def encode_url(text: Column) -> Column:
    """Percent-encoding with %20 for blanks."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def zoom_level(width: Column, least: int = 0) -> Column:
    """Map zoom for a raster's width in pixels."""
    return F.greatest(F.least(14 - width / 5000, F.lit(16.0)), F.lit(float(least)))


def safe_float(value: Column, default: float) -> Column:
    """A finite number or the default."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), default).otherwise(v)


def azimuths(text: Column) -> Column:
    """Sun azimuths from a comma-separated list: blank entries are passed over, an entry that is no number is an error in any mode."""
    wrong = lambda x: F.raise_error(F.concat(F.lit("Not an azimuth: "), x)).cast("double")
    given = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(given, lambda x: F.coalesce(x.try_cast("double"), wrong(x)))


def crs_id(authority: Column, code: Column, wkt: Column) -> Column:
    """AUTHORITY:code, else the WKT."""
    return F.coalesce(F.concat(authority, F.lit(":"), code.cast("string")), wkt)
