"""Hard negatives by bit-sliced integer products.

A vector becomes whole numbers floor(scale * x), and its components are read bit
plane by bit plane, the most significant first (two's complement, so that the
sign is the first plane).  After some planes a score lies between what the planes
so far give and that plus the most or least that the rest can add; a candidate
goes once its interval cannot hold a score that still counts, and the last plane
leaves exact scores.

Work is laid out as a grid of cells: anchors in blocks of at most about
``ANCHOR_ROWS``, rows in blocks of at most about ``BLOCK_ROWS``, each pair of
blocks a task of its own with bounded memory.  Anchors are a stated query set
that meets every row, so the number of cells grows with rows times anchors; an
anchor is sent once to each block of rows and a row once to each block of anchors.
A cell returns a bounded number of rows for each anchor, and those are ranked by
Spark.  The search runs twice: for the positives, then for the negatives in the
bands that the positives' scores give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurian.llm.store import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of the positive's.
BAND = (30, 90)
ANCHOR_ROWS = 4096
BLOCK_ROWS = 65536
#: Anchors and rows whose intervals are held at a time.
TILE_ANCHORS = 256
TILE_ROWS = 8192
#: The share of pairs from which on planes are summed pair by pair instead of as one product.
SPARSE = 0.02


@dataclass
class Tile:
    """Rows of one tile with their bit planes; value = -2**bits * first plane + sum of 2**(bits - k) * plane k."""

    ids: np.ndarray
    labels: np.ndarray
    bits: int
    planes: list[np.ndarray]


def tile_of(values: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Tile:
    bits = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1).bit_length()
    return Tile(ids, labels, bits, [values >> b & 1 for b in range(bits, -1, -1)])


def _most(values: np.ndarray) -> int:
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def kind_for(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The smallest number type that holds every sum on the way exactly."""
    most = 4 * (_most(anchors) + 1) * (_most(rows) + 1) * max(1, anchors.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def best_in(anchors: np.ndarray, tile: Tile, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, kind: type) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) for each slot: the ``most`` best allowed rows with a score in [low, high], found plane by plane.

    ``low`` and ``high`` have a column for each slot of an anchor, ``allowed`` says
    which rows an anchor may take (anchor x row).  A slot's bar is its lower bound,
    raised as soon as ``most`` rows are certain to lie in its band and to score at
    least as much.  Rows that reach no bar of their anchor go, ties stay.
    """
    a = anchors.astype(kind)
    plus, minus = np.where(a > 0, a, 0).sum(axis=1), np.where(a < 0, a, 0).sum(axis=1)
    bar = low.copy()
    part = np.zeros(allowed.shape, kind)
    alive, i = allowed, None
    for step, plane in enumerate(tile.planes):
        weight, rest = (1 << tile.bits - step) * (1 if step else -1), (1 << tile.bits - step) - 1
        if i is None:
            part += weight * (a @ plane.T.astype(kind))
            near, far = bar.min(axis=1) - rest * plus, high.max(axis=1) - rest * minus
            alive = allowed & (part >= near[:, None]) & (part <= far[:, None])
            if rest and alive.sum() > SPARSE * alive.size:
                continue
            i, j = np.nonzero(alive)
            score = part[i, j]
        else:
            score = score + weight * _pair_sums(a, plane, i, j)
        least, top = score + rest * minus[i], score + rest * plus[i]
        keep = np.zeros(len(i), bool)
        for s in range(bar.shape[1]):
            sure = (least >= low[i, s]) & (top <= high[i, s])
            bar[:, s] = np.maximum(bar[:, s], _nth_best(i[sure], least[sure], most, bar[:, s]))
            keep |= (top >= bar[i, s]) & (least <= high[i, s])
        i, j, score = i[keep], j[keep], score[keep]
    found = []
    for s in range(bar.shape[1]):
        ok = np.flatnonzero((score >= bar[i, s]) & (score <= high[i, s]))
        order = ok[np.lexsort((tile.ids[j[ok]], -score[ok], i[ok]))]
        order = order[_place(i[order]) < most]
        found.append((i[order], j[order], score[order]))
    return found


def _place(group: np.ndarray) -> np.ndarray:
    """The place of each element in its group, from 0; groups stand together in rising order."""
    return np.arange(len(group)) - np.searchsorted(group, group)


def _pair_sums(a: np.ndarray, plane: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = [(a[i[k : k + 65536]] * plane[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]
    return np.concatenate(out) if out else np.zeros(0, a.dtype)


def _nth_best(group: np.ndarray, value: np.ndarray, nth: int, least: np.ndarray) -> np.ndarray:
    """The ``nth`` highest value of each group (numbered as ``least``), ``least`` for groups with fewer."""
    order = np.lexsort((-value, group))
    at = _place(group[order]) == nth - 1
    out = least.copy()
    out[group[order][at]] = value[order][at]
    return out


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """id, label, v: rows with whole components, one row for each id.

    Rows with a null id, label or vector, or with any null or non-finite
    component, are left out.  Of rows that share an id that with the smallest
    label, then vector, stays; rows that repeat are one.
    """
    d = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    # Beyond 62 bits whole numbers end; such components stand at the end of the range.
    bound = lambda x: F.greatest(F.least(x, F.lit(float(1 << 61))), F.lit(-float(1 << 61)))
    d = d.select("id", F.struct("label", F.transform("x", lambda x: bound(F.floor(F.lit(float(scale)) * x).cast("double")).cast("long")).alias("v")).alias("r"))
    return d.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, filled up with zeros; exact integers where long ones could overflow."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns if len(c)), default=0)


def _in_cell(asked: pa.Table, rows: pa.Table, most: int, band: tuple[int, int] | None) -> list[np.ndarray]:
    """(anchor, slot, row, score) over a cell, in tiles.

    Without a band the rows of the anchor's own label, but for itself; with one
    those of other labels, a slot for each score in ``asked.scores``.
    """
    width = _width(asked["v"], rows["v"])
    a, r = _matrix(asked["v"], width), _matrix(rows["v"], width)
    kind = kind_for(a, r)
    if kind is object:
        a, r = a.astype(object), r.astype(object)
    a_id, r_id, a_label, r_label = (t[c].to_numpy() for t, c in ((asked, "id"), (rows, "id"), (asked, "label"), (rows, "label")))
    never = kind(1 << 24) if kind is np.float32 else kind(1 << 53) if kind is np.float64 else 1 << 200
    if band is None:
        low, high = np.full((len(a), 1), -never), np.full((len(a), 1), never)
    else:
        scores = _matrix(asked["scores"], _width(asked["scores"])).astype(object)
        # Whole bounds: the least score is rounded up, the most down.
        low, high = (np.minimum(np.maximum(x, -never), never).astype(kind) for x in (-(-scores * band[0] // 100), scores * band[1] // 100))
        none = np.arange(scores.shape[1]) >= np.array([len(x) for x in asked["scores"].to_pylist()])[:, None]
        low[none], high[none] = never, -never
    bar, out = low.copy(), []
    # The first tile is small: what it finds is a bar for all others.
    edges = [0, *range(min(1024, len(r)), len(r), TILE_ROWS), len(r)]
    for q, end in zip(edges, edges[1:], strict=False):
        tile = tile_of(r[q:end], r_id[q:end], r_label[q:end])
        for p in range(0, len(a), TILE_ANCHORS):
            ps = slice(p, p + TILE_ANCHORS)
            mine = a_label[ps, None] == tile.labels
            allowed = mine & (a_id[ps, None] != tile.ids) if band is None else ~mine
            for s, (i, j, score) in enumerate(best_in(a[ps], tile, allowed, bar[ps], high[ps], most, kind)):
                out.append((i + p, np.full(len(i), s), j + q, score))
                full = _place(i) == most - 1
                bar[i[full] + p, s] = np.maximum(bar[i[full] + p, s], score[full])
    i, s, j, score = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((r_id[j], -score, s, i))
    order = order[_place((i * low.shape[1] + s)[order]) < most]
    return [i[order], s[order], j[order], score[order]]


def _as_long(score: np.ndarray) -> pa.Array:
    """Scores; one beyond the range of a long stands at its end."""
    if score.dtype != object:
        return pa.array(score.astype(np.int64))
    return pa.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in score], pa.int64())


def _searched(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, most: int, band: tuple[int, int] | None) -> DataFrame:
    """anchor, slot, id, score of the best rows of every cell."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, -(-n_anchors // ANCHOR_ROWS))
    down = max(1, -(-n_rows // BLOCK_ROWS), min(-(-tasks // across), -(-n_rows // 1024)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("cell", every(down)).withColumn("cell", F.col("cell") * across + block(across))
    right = rows.withColumn("cell", every(across)).withColumn("cell", F.col("cell") + block(down) * across)

    def cell(asked: pa.Table, met: pa.Table) -> pa.Table:
        i, s, j, score = _in_cell(asked, met, most, band) if len(asked) and len(met) else [np.zeros(0, np.int64)] * 4
        return pa.table({"anchor": asked["id"].take(pa.array(i)), "slot": pa.array(s, pa.int64()), "id": met["id"].take(pa.array(j)), "score": _as_long(score)})

    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell, "anchor long, slot long, id long, score long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Callable[[Column], Column], positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the whole inner product of two rows' whole components; higher ones
    come first, ties by smaller id.  An anchor's positives are its first other rows
    of the same label, and for each of them the first rows of other labels are
    returned whose score is ``band`` hundredths of the positive's.  ``is_anchor``
    tells anchors by their id.  Anchors without a positive and positives without a
    negative in their band give no row, nor does an empty table.

    :func:`whole_numbers` says which rows take part.  Vectors of different lengths
    are filled up with zeros.  Components so large that a double would not hold
    their sums are multiplied exactly; a score beyond a long counts as its end.
    """
    whole = materialise(whole_numbers(vectors, id_col, vector_col, label_col, scale), "vectors")
    anchors = materialise(whole.where(is_anchor(F.col("id"))), "anchors")
    size = (anchors.count(), whole.count())
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    first = _searched(anchors, whole, *size, positives, None).withColumn("slot", F.row_number().over(order) - 1)
    first = materialise(first.where(F.col("slot") < positives).select("anchor", F.col("slot").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # A few positives an anchor, in the order of their slots.
    scores = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score")))["positive_score"].alias("scores"))
    far = _searched(anchors.join(scores.withColumnRenamed("anchor", "id"), "id"), whole, *size, negatives, band)
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    return far.join(first, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
