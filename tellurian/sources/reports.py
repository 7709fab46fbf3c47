"""Small documents made on the driver from one-row results: report, viewer page, field project."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

from tellurian.operators import blend
from tellurian.sources.files import viewer_config

#: Columns of a field survey record and whether each must be filled.
ANOMALY_FIELDS = (
    ("anomaly_id", "string", True), ("feature_type", "string", True), ("confidence", "string", True), ("length_m", "double", False), ("width_m", "double", False),
    ("height_m", "double", False), ("condition", "string", False), ("surveyor", "string", False), ("notes", "string", False),
)


def anomaly_template(spark: SparkSession) -> DataFrame:
    """An empty field record table with a point geometry as WKT."""
    return spark.createDataFrame([], ", ".join([*(f"{n} {t}{' NOT NULL' if must else ''}" for n, t, must in ANOMALY_FIELDS), "wkt string"]))


def statistics_report(cells: DataFrame, title: str, parameters: dict, bins: int = 20) -> str:
    """Title, parameters, statistics and a bar per histogram bin, as Markdown."""
    row = blend.report_statistics(cells).first().asDict()
    counts = sorted((r["bin"], r["n"]) for r in blend.histogram(cells, bins=bins).collect())
    top = max((n for _, n in counts), default=1)
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in sorted(parameters.items())), "", "| statistic | value |", "| --- | --- |"]
    lines += [f"| {k} | {v:.6g} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.items()]
    return "\n".join([*lines, "", *(f"{b:>3} {'#' * round(40 * n / top)} {n}" for b, n in counts), ""])


def viewer_page(title: str, image: str, zoom: float = 12.0, opacity: float = 1.0, centre: tuple[float, float] = (0.0, 0.0)) -> str:
    """A self-contained page that shows one image; text is escaped, numbers are made finite."""
    config = viewer_config(title, zoom, opacity, centre).replace("<", "\\u003c")
    safe = escape(image, {'"': "&quot;"})
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><img src="{safe}"><script>const config = {config};document.querySelector("img").style.opacity = config.opacity;</script></body></html>'


def field_project(name: str, layers: list[str], choices: dict[str, list[str]]) -> str:
    """A project description in XML: layers and the value lists of choice fields."""
    maps = "".join(f'<field name="{escape(f)}">' + "".join(f"<value>{escape(v)}</value>" for v in vs) + "</field>" for f, vs in sorted(choices.items()))
    return f'<?xml version="1.0" encoding="UTF-8"?><project name="{escape(name)}"><layers>{"".join(f"<layer>{escape(x)}</layer>" for x in layers)}</layers><fields>{maps}</fields></project>'


def pyramid_complaints(layout: dict) -> list[str]:
    """What keeps a written pyramid from serving windows cheaply."""
    out = []
    if not layout.get("tiled"):
        out.append("not tiled")
    if layout.get("block", 0) < 64:
        out.append("blocks smaller than 64 cells")
    if max(layout.get("rows", 0), layout.get("cols", 0)) > 1024 and not layout.get("overviews"):
        out.append("no overviews")
    return out


def outlier_pipeline(source: str, target: str, neighbours: int = 8, multiplier: float = 2.0) -> str:
    """Stages of a removal of statistical outliers as JSON: ordinary points (code 1) are kept."""
    drop = {"type": "filters.outlier", "method": "statistical", "mean_k": neighbours, "multiplier": multiplier}
    return json.dumps([{"type": "readers.las", "filename": source}, drop, {"type": "filters.range", "limits": "Classification[1:1]"}, {"type": "writers.las", "filename": target}])


def point_pipeline(preset: dict, resolution: float, source: str, target: str) -> str:
    """Stages of a ground classification as JSON."""
    pmf = {"type": "filters.pmf", **preset}
    return json.dumps([{"type": "readers.las", "filename": source}, pmf, {"type": "filters.range", "limits": "Classification[2:2]"}, {"type": "writers.gdal", "output_type": "idw", "resolution": resolution, "filename": target}])
