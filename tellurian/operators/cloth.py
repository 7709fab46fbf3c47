"""The cloth filter (Zhang et al. 2016) on a raster of any size: bulk-synchronous rounds over tiles.

Node states are a table, a row per tile.  In a superstep every tile gets the
margins of its neighbours, moves its nodes for several rounds and keeps its own
part; the margin is as wide as what those rounds can bring in, so that each node
moves as it would on the whole raster.  A tile also says how far its nodes moved
in each round.  The filter stops after the first round in which no node of any
tile moved far: if that lies inside a superstep, this one is run again up to
there.  Results do not depend on the tiling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurian.operators.lineage import cut

#: Fixed values of the published filter: greatest number of rounds, the movement that ends it, and the step up to which slopes are smoothed.
ROUNDS, STILL, STEP = 500, 0.005, 0.3
#: Nodes on the side of a tile.
TILE = 256


@dataclass(frozen=True)
class Raster:
    """The rectangle of all nodes and its tiles; heights are those of the inverted cloud."""

    r0: int
    c0: int
    rows: int
    cols: int
    tile: int
    low: float
    high: float

    @property
    def across(self) -> int:
        return -(-self.cols // self.tile)

    @property
    def tiles(self) -> int:
        return -(-self.rows // self.tile) * self.across

    def box(self, t: int, margin: int = 0) -> tuple[int, int, int, int]:
        """First and past-the-last row and column of tile ``t``, with a margin inside the rectangle."""
        r, c = t // self.across * self.tile, t % self.across * self.tile
        return max(0, r - margin), min(self.rows, r + self.tile + margin), max(0, c - margin), min(self.cols, c + self.tile + margin)


def fall(state: np.ndarray, moving: np.ndarray, rigidness: int, time_step: float) -> None:
    """One round of nodes with (height, last height, floor): gravity, ``rigidness`` pulls along both axes, collision."""
    cloth, last, floor = state
    drop = np.where(moving, (cloth - last) * 0.99 - 0.2 * time_step * time_step, 0.0)
    last[...] = cloth
    cloth += drop
    for _ in range(rigidness):
        for axis in (0, 1):
            ahead, behind = (np.s_[:-1], np.s_[1:]) if axis == 0 else (np.s_[:, :-1], np.s_[:, 1:])
            gap, free, other = cloth[behind] - cloth[ahead], moving[ahead], moving[behind]
            share = np.where(free & other, gap / 2, gap) * 0.5
            cloth[ahead] += np.where(free, share, 0)
            cloth[behind] -= np.where(other, share, 0)
    hit = cloth <= floor
    cloth[hit] = floor[hit]
    moving[hit] = False


def lay_down(state: np.ndarray, moving: np.ndarray) -> np.ndarray:
    """Nodes that hang just above the floor beside a resting one on about the same level are laid down; tells which."""
    cloth, _, floor = state
    beside = np.zeros(moving.shape, bool)
    for ahead, behind in ((np.s_[:-1], np.s_[1:]), (np.s_[:, :-1], np.s_[:, 1:])):
        level = np.abs(floor[ahead] - floor[behind]) < STEP
        beside[ahead] |= level & ~moving[behind]
        beside[behind] |= level & ~moving[ahead]
    down = moving & beside & (cloth - floor < STEP)
    cloth[down] = floor[down]
    moving[down] = False
    return down


def _pack(state: np.ndarray, moving: np.ndarray) -> bytes:
    return state.tobytes() + moving.tobytes()


def _unpack(data: bytes, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    n = 24 * rows * cols
    return np.frombuffer(data[:n]).reshape(3, rows, cols).copy(), np.frombuffer(data[n:], bool).reshape(rows, cols).copy()


def _begin(nodes: DataFrame, grid: Raster) -> DataFrame:
    """(tile, state, moved): the cloth above everything; nodes without a point have the lowest floor."""

    def fill(asked: pa.Table, met: pa.Table) -> pa.Table:
        t = asked["id"][0].as_py()
        a, b, c, d = grid.box(t)
        state = np.full((3, b - a, d - c), grid.high + 1.0)
        state[2] = grid.low
        if len(met):
            state[2, met["r"].to_numpy() - a, met["c"].to_numpy() - c] = met["h"].to_numpy()
        return pa.table({"tile": [t], "state": [_pack(state, np.ones((b - a, d - c), bool))], "moved": pa.array([[]], pa.list_(pa.float64()))})

    tile = F.floor(F.col("r") / grid.tile) * grid.across + F.floor(F.col("c") / grid.tile)
    return cut(nodes.sparkSession.range(grid.tiles).groupBy("id").cogroup(nodes.groupBy(tile.alias("tile"))).applyInArrow(fill, "tile long, state binary, moved array<double>"))


def _superstep(states: DataFrame, grid: Raster, margin: int, run: Callable[[np.ndarray, np.ndarray, tuple], list[float]]) -> DataFrame:
    """The next states: tiles send their parts to all whose margin holds them, and ``run`` works on each with its margin."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, data in zip(batch.column("tile").to_pylist(), batch.column("state").to_pylist(), strict=True):
                a, b, c, d = grid.box(t)
                state, moving = _unpack(data, b - a, d - c)
                reach = -(-margin // grid.tile)
                tr, tc = divmod(t, grid.across)
                for r in range(max(0, tr - reach), min(-(-grid.rows // grid.tile), tr + reach + 1)):
                    for k in range(max(0, tc - reach), min(grid.across, tc + reach + 1)):
                        e, f, g, h = grid.box(r * grid.across + k, margin)
                        e, f, g, h = max(a, e), min(b, f), max(c, g), min(d, h)
                        if e < f and g < h:
                            part = np.s_[e - a : f - a, g - c : h - c]
                            yield pa.RecordBatch.from_pydict({"tile": [r * grid.across + k], "a": [e], "b": [f], "c": [g], "d": [h], "part": [_pack(state[:, *part], moving[part])]})

    def step(met: pa.Table) -> pa.Table:
        t = met["tile"][0].as_py()
        a, b, c, d = grid.box(t, margin)
        state, moving = np.empty((3, b - a, d - c)), np.empty((b - a, d - c), bool)
        for row in met.to_pylist():
            part = np.s_[row["a"] - a : row["b"] - a, row["c"] - c : row["d"] - c]
            state[:, *part], moving[part] = _unpack(row["part"], row["b"] - row["a"], row["d"] - row["c"])
        e, f, g, h = grid.box(t)
        own = np.s_[e - a : f - a, g - c : h - c]
        moved = run(state, moving, own)
        return pa.table({"tile": [t], "state": [_pack(np.ascontiguousarray(state[:, *own]), moving[own])], "moved": pa.array([moved], pa.list_(pa.float64()))})

    sent = states.select("tile", "state").mapInArrow(send, "tile long, a long, b long, c long, d long, part binary")
    return cut(sent.groupBy("tile").applyInArrow(step, "tile long, state binary, moved array<double>"))


def _moved(states: DataFrame) -> list[float]:
    """The greatest movement of any tile in each round of the last superstep."""
    found = states.select(F.posexplode("moved").alias("k", "far")).groupBy("k").agg(F.max("far").alias("far")).orderBy("k").collect()
    return [r.far for r in found]


def draped(nodes: DataFrame, rigidness: int, time_step: float, slope_smooth: bool, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """(r, c, cloth): the fallen cloth over nodes (r, c, h) with inverted heights, for every node of their rectangle."""
    r0, r1, c0, c1, low, high = nodes.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.min("h"), F.max("h")).first()
    if r0 is None:
        return nodes.select("r", "c", F.col("h").alias("cloth"))
    grid = Raster(r0, c0, r1 - r0 + 1, c1 - c0 + 1, tile, low, high)
    states = _begin(nodes.select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), "h"), grid)
    # So many rounds that the margins are about half a tile.
    most = max(1, tile // 2 // rigidness)

    def falling(n: int) -> Callable:
        def run(state: np.ndarray, moving: np.ndarray, own: tuple) -> list[float]:
            out = []
            for _ in range(n):
                fall(state, moving, rigidness, time_step)
                out.append(float(np.abs(state[0][own] - state[1][own]).max()))
            return out

        return run

    done = 0
    while done < rounds:
        n = min(most, rounds - done)
        after = _superstep(states, grid, n * rigidness, falling(n))
        still = [k for k, far in enumerate(_moved(after)) if far < STILL]
        if still and still[0] + 1 < n:
            # It came to rest inside this superstep: once more, up to there.
            after = _superstep(states, grid, (still[0] + 1) * rigidness, falling(still[0] + 1))
        states, done = after, done + n
        if still:
            break

    def laying(state: np.ndarray, moving: np.ndarray, own: tuple) -> list[float]:
        return [float(lay_down(state, moving)[own].sum()) for _ in range(tile // 2)]

    while slope_smooth:
        states = _superstep(states, grid, max(1, tile // 2), laying) if tile > 1 else _superstep(states, grid, 1, lambda s, m, own: [float(lay_down(s, m)[own].sum())])
        if not _moved(states)[-1]:
            break

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, data in zip(batch.column("tile").to_pylist(), batch.column("state").to_pylist(), strict=True):
                a, b, c, d = grid.box(t)
                state, _ = _unpack(data, b - a, d - c)
                r, k = np.meshgrid(np.arange(a, b), np.arange(c, d), indexing="ij")
                yield pa.RecordBatch.from_pydict({"r": r.ravel() + grid.r0, "c": k.ravel() + grid.c0, "cloth": state[0].ravel()})

    return states.select("tile", "state").mapInArrow(rows, "r long, c long, cloth double")
