"""Model inference over haloed tiles, and the resizing around it.

A session is built once per Python worker and run; tiles arrive as groups of
cells, so that a raster of any size is read by as many tasks as it has tiles.  Without
onnxruntime the import fails only when a model is run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.operators import detect
from tellurian.operators.grid import grid_stats, haloed
from tellurian.operators.lineage import cut
from tellurian.operators.quantiles import quantiles


def resize_index(n_out: int, n_in: int) -> np.ndarray:
    """Source index under the centre of each output cell."""
    return np.minimum(((np.arange(n_out) + 0.5) * n_in / n_out).astype(int), n_in - 1)


def resize_nearest(labels: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Labels on another grid, never interpolated."""
    return labels[np.ix_(resize_index(shape[0], labels.shape[0]), resize_index(shape[1], labels.shape[1]))]


def resize_bilinear(image: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Half-pixel bilinear resize of (rows, cols) or (rows, cols, channels)."""

    def ends(n_out: int, n_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n_in - 1), at - low

    (r0, r1, fr), (c0, c1, fc) = ends(shape[0], image.shape[0]), ends(shape[1], image.shape[1])
    fr, fc = (fr[:, None, None], fc[None, :, None]) if image.ndim == 3 else (fr[:, None], fc[None, :])
    top = image[np.ix_(r0, c0)] * (1 - fc) + image[np.ix_(r0, c1)] * fc
    low = image[np.ix_(r1, c0)] * (1 - fc) + image[np.ix_(r1, c1)] * fc
    return top * (1 - fr) + low * fr


def model_kind(name: Column, outputs: Column, dimensions: Column) -> Column:
    """``segmentation`` or ``detection``, by the file's name, else by a single four-dimensional output."""
    low = F.lower(name)
    return F.when(low.rlike("seg|unet|deeplab"), "segmentation").when(low.rlike("yolo|detect"), "detection").when((outputs == 1) & (dimensions == 4), "segmentation").otherwise("detection")


def display_range(cells: DataFrame, value: str = "z") -> tuple[float, float]:
    """2-98 percentile range of a layer, its extremes if that is empty."""
    p = quantiles(cells, value, (0.02, 0.98, 0.0, 1.0)) or (0.0,) * 4
    return (p[0], p[1]) if p[1] > p[0] else (p[2], p[3])


def tile_input(block: np.ndarray, size: tuple[int, int], low: float, high: float) -> np.ndarray:
    """(1, 3, rows, cols) float32 in 0..1: nodata as the low end, one layer in three channels."""
    z = np.clip((np.where(np.isnan(block), low, block) - low) / max(high - low, 1e-9), 0, 1)
    return np.repeat(resize_bilinear(z, size)[None, None], 3, axis=1).astype(np.float32)


def onnx_runner(model: bytes) -> Callable[[], Callable[[np.ndarray], list]]:
    """A factory that workers call once: input array -> outputs of the model."""

    def build() -> Callable[[np.ndarray], list]:
        import onnxruntime

        session = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x})

    return build


#: The sessions of this worker by the number of their run, of which the newest ones stay.
_RUNNERS: dict[str, Callable[[np.ndarray], list]] = {}
MOST_RUNNERS = 4


def _runner(name: str, build: Callable[[], Callable[[np.ndarray], list]]) -> Callable[[np.ndarray], list]:
    """The session of a run, built at its first tile in this worker."""
    if name not in _RUNNERS:
        while len(_RUNNERS) >= MOST_RUNNERS:
            del _RUNNERS[next(iter(_RUNNERS))]
        _RUNNERS[name] = build()
    return _RUNNERS[name]


def segment(cells: DataFrame, runner: Callable[[], Callable[[np.ndarray], list]], threshold: float, tile: int = 512, overlap: int = 64, size: tuple[int, int] = (512, 512)) -> DataFrame:
    """(r, c, label, confidence) of every cell: each tile is read with its overlap and answers for its core."""
    low, high = display_range(cells)
    halo = overlap // 2
    stats = grid_stats(cells)
    name = uuid.uuid4().hex

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf["is_core"].to_numpy(bool)
        if not core.any():
            return pd.DataFrame({"r": pd.Series(dtype="int64"), "c": pd.Series(dtype="int32"), "label": pd.Series(dtype="int32"), "confidence": pd.Series(dtype=float)})
        model = _runner(name, runner)
        r0, c0 = max(pdf["r"].min(), stats.first_r), max(pdf["c"].min(), stats.first_c)
        r, c = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        block = np.full((r.max() + 1, c.max() + 1), np.nan)
        block[r, c] = pdf["z"].to_numpy(float)
        logits = np.asarray(model(tile_input(block, size, low, high))[0])
        if logits.ndim != 4:
            raise ValueError("A segmentation model answers with (batch, class, row, column)")
        x = logits[0].astype(float)
        if len(x) == 1:
            p = 1 / (1 + np.exp(-x[0]))
            label, sure = (p >= threshold).astype(int), np.where(p >= threshold, p, 1 - p)
        else:
            e = np.exp(x - x.max(axis=0))
            p = e / e.sum(axis=0)
            sure = p.max(axis=0)
            label = np.where(sure >= threshold, p.argmax(axis=0), 0)
        label, sure = resize_nearest(label, block.shape), resize_nearest(sure, block.shape)
        return pd.DataFrame({"r": pdf["r"].to_numpy()[core], "c": pdf["c"].to_numpy()[core], "label": label[r[core], c[core]].astype("int32"), "confidence": sure[r[core], c[core]]})

    return haloed(cells.select("r", "c", "z"), tile, halo).groupBy("tile_r", "tile_c").applyInPandas(run, "r long, c int, label int, confidence double")


def model_boxes(outputs: list[np.ndarray]) -> np.ndarray:
    """(n, 6) corners, confidence and class of a detection model's outputs, in any of three layouts.

    One output of six columns holds corners, confidence and class; one of more
    holds centre, size, objectness and a score per class; four outputs hold the
    number of boxes, their corners, scores and classes.
    """
    first = [np.asarray(o, float) for o in outputs]
    if len(first) >= 4:
        n = int(first[0].ravel()[0])
        corners, scores, classes = (o[0] if o.ndim > k else o for o, k in zip(first[1:4], (2, 1, 1), strict=True))
        return np.column_stack([corners[:n, :4], scores[:n], classes[:n]])
    if len(first) != 1 or first[0].ndim != 3 or first[0].shape[2] < 6:
        raise ValueError("Unknown layout of a detection model's outputs")
    d = first[0][0]
    if d.shape[1] == 6:
        return d
    kind = d[:, 5:].argmax(axis=1)
    half = d[:, 2:4] / 2
    return np.column_stack([d[:, :2] - half, d[:, :2] + half, d[:, 4] * d[np.arange(len(d)), 5 + kind], kind])


def windowed(cells: DataFrame, size: int, overlap: int, rows: int, cols: int) -> DataFrame:
    """Each cell once for every window that holds it; windows start ``size - overlap`` cells apart, the last one's start inside the grid."""
    stride = size - overlap
    if stride < 1:
        raise ValueError("The overlap must be smaller than the tile")
    reach = lambda x, n: F.sequence(F.greatest(F.floor((F.col(x) - size) / stride) + 1, F.lit(0)), F.least(F.floor(F.col(x) / stride), F.lit((n - 1) // stride)))
    return cells.withColumn("tile_r", F.explode(reach("r", rows))).withColumn("tile_c", F.explode(reach("c", cols)))


def detect_features(
    cells: DataFrame, runner: Callable[[], Callable[[np.ndarray], list]], threshold: float = 0.5, iou: float = 0.45, tile: int = 640, overlap: int = 32,
    size: tuple[int, int] = (640, 640), labels: list[str] | None = None,
) -> DataFrame:
    """(id, x1, y1, x2, y2, confidence, class_id, class_name): a detection model over overlapping tiles, merged by suppression.

    Boxes come in pixels of the whole grid, clamped to their tile; those that two
    tiles see are settled by non-maximum suppression over the union.
    """
    low, high = display_range(cells)
    stats = grid_stats(cells)
    moved = cells.select((F.col("r") - stats.first_r).alias("r"), (F.col("c") - stats.first_c).alias("c"), "z")
    rows, cols = stats.last_r - stats.first_r + 1, stats.last_c - stats.first_c + 1
    name, stride = uuid.uuid4().hex, tile - overlap
    kinds = {"off_x": "int64", "off_y": "int64", "tile_w": "int64", "tile_h": "int64", "n": "int64"} | dict.fromkeys(("x1", "y1", "x2", "y2", "confidence"), "float64") | {"class_id": "int32"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tile_r"].iat[0]) * stride, int(pdf["tile_c"].iat[0]) * stride
        block = np.full((min(tile, rows - r0), min(tile, cols - c0)), np.nan)
        block[pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0] = pdf["z"].to_numpy(float)
        found = model_boxes(_runner(name, runner)(tile_input(block, size, low, high)))
        found = found[found[:, 4] >= threshold]
        out = pd.DataFrame(found[:, :6], columns=["x1", "y1", "x2", "y2", "confidence", "class_id"])
        out = out.assign(off_x=c0, off_y=r0, tile_w=block.shape[1], tile_h=block.shape[0], n=np.arange(len(found)))
        return out[list(kinds)].astype(kinds)

    schema = ", ".join(f"{n} { {'int64': 'long', 'int32': 'int'}.get(t, 'double') }" for n, t in kinds.items())
    raw = windowed(moved, tile, overlap, rows, cols).groupBy("tile_r", "tile_c").applyInPandas(run, schema)
    numbered = raw.withColumn("id", (F.col("off_y") * cols + F.col("off_x")) * (1 << 20) + F.col("n"))
    # Written once: a model need not answer twice for the rounds of suppression.
    boxes = cut(detect.decode_boxes(numbered, threshold, size, labels or []))
    return detect.suppress(boxes, iou)
