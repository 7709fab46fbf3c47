"""Nearest points by rings of buckets: the numpy kernel that runs inside a tile."""

from __future__ import annotations

import numpy as np


class Buckets:
    """Points sorted by square bucket, row by row, about four to a bucket."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: float) -> None:
        self.x0, self.y0 = x.min(), y.min()
        wide, high = x.max() - self.x0, y.max() - self.y0
        self.size = max(np.sqrt(max(wide, least) * max(high, least) * 4 / len(x)), least / 64, max(wide, high) / 4096, 1e-12)
        self.cols, self.rows = int(wide / self.size) + 1, int(high / self.size) + 1
        bucket = self._place(y, self.y0, self.rows) * self.cols + self._place(x, self.x0, self.cols)
        self.order = np.argsort(bucket, kind="stable")
        self.first = np.searchsorted(bucket[self.order], np.arange(self.rows * self.cols + 1))

    def _place(self, v: np.ndarray, origin: float, n: int) -> np.ndarray:
        return np.clip(np.floor((v - origin) / self.size).astype(np.int64), 0, n - 1)

    def within(self, cx: np.ndarray, cy: np.ndarray, ring: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(query, point) pairs of the buckets up to ``ring`` away, and the distance up to which none is missed."""
        # A query outside the points' rectangle counts from where it stands.
        bx, by = np.floor((cx - self.x0) / self.size).astype(np.int64), np.floor((cy - self.y0) / self.size).astype(np.int64)
        step = np.arange(-ring, ring + 1)
        rows = by[:, None] + step[None, :]
        low, high = np.clip(bx - ring, 0, self.cols), np.clip(bx + ring + 1, 0, self.cols)
        ok = (rows >= 0) & (rows < self.rows) & (low < high)[:, None]
        base = np.where(ok, rows, 0) * self.cols
        start, stop = self.first[base + np.where(ok, low[:, None], 0)], self.first[base + np.where(ok, high[:, None], 0)]
        count = np.where(ok, stop - start, 0).ravel()
        query = np.repeat(np.arange(len(cx)), count.reshape(len(cx), -1).sum(axis=1))
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start.ravel(), count)
        return query, self.order[at], ring * self.size


def nearest(x: np.ndarray, y: np.ndarray, z: np.ndarray, cx: np.ndarray, cy: np.ndarray, k: int, reach: float, cz: np.ndarray | None = None, skip_self: bool = False, pairs: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance): of each query its ``k`` nearest points within ``reach``, nearest first.

    Distances are in the plane, or in space where the queries' heights ``cz`` are
    given; ties go by z, x, y.  ``skip_self`` leaves out the point of the query's
    own number.  Rings double until a query has k points that no farther bucket
    can beat.  Points with no finite coordinate must be left out before.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(x) or not len(cx):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    b = Buckets(x, y, reach / 64 if np.isfinite(reach) else 1e-9)
    todo, ring = np.arange(len(cx)), 1
    span = max(b.rows, b.cols)
    while len(todo):
        rest = []
        # Queries go in groups whose candidate pairs fit into memory.
        each = max(1, len(x) * (2 * ring + 1) ** 2 // max(1, b.rows * b.cols))
        step = max(1, pairs // each)
        for lo in range(0, len(todo), step):
            q = todo[lo : lo + step]
            of, point, sure = b.within(cx[q], cy[q], ring)
            dx, dy = x[point] - cx[q][of], y[point] - cy[q][of]
            d2 = dx * dx + dy * dy
            if cz is not None:
                d2 = d2 + (z[point] - cz[q][of]) ** 2
            last = sure >= reach or ring > 2 * span + 2 * _beyond(b, cx[q], cy[q])
            keep = d2 <= (reach * reach if last else min(sure, reach) ** 2)
            if skip_self:
                keep &= q[of] != point
            of, point, d2 = of[keep], point[keep], d2[keep]
            order = np.lexsort((y[point], x[point], z[point], d2, of))
            of, point, d2 = of[order], point[order], d2[order]
            start = np.searchsorted(of, np.arange(len(q)))
            rank = np.arange(len(of)) - start[of]
            done = np.ones(len(q), bool) if last else np.bincount(of, minlength=len(q)) >= k
            take = (rank < k) & done[of]
            found.append((q[of[take]], point[take], d2[take]))
            rest.append(q[~done])
        todo = np.concatenate(rest)
        ring *= 2
    parts = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.argsort(parts[0], kind="stable")
    return parts[0][order], parts[1][order], parts[2][order]


def _beyond(b: Buckets, cx: np.ndarray, cy: np.ndarray) -> int:
    """How many buckets the farthest query lies outside the points' rectangle."""
    out = max(b.x0 - cx.min(), cx.max() - b.x0 - b.cols * b.size, b.y0 - cy.min(), cy.max() - b.y0 - b.rows * b.size, 0.0)
    return int(out / b.size) + 1
