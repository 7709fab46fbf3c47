"""SimHash near-dedup with vantage-point trees.

Fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit of
their upper or of their lower half.  So two forests are kept, one per half, over
the metric space of 32-bit halves under Hamming distance, and each is searched
with radius 1 instead of 3; candidates are checked on all 64 bits.  This keeps
the search exact, and triangle bounds prune far more at radius 1.

* The top of each tree is built from a bounded sample: at every node a vantage
  point and the median distance of the sample to it.  Its depth follows from the
  number of fingerprints; below the levels that a sample can tell about, vantage
  points are pseudo-random and the radius is the median of random halves, which
  SimHash halves are like.  Every fingerprint descends
  to one home shard (distance at most the median: left), and as a query it also
  enters the sibling wherever its distance is within 1 of the boundary.
* A shard task continues the tree on its own points, splitting the points and
  the queries that can reach them, down to small leaves that are compared in
  blocks.  Points that share one half and so cannot be split by it are split by
  the other half, with radius 3.  It answers with a spanning forest of the links it found, never with
  the pairs: at most one edge per query.
* Components over the edges are found by alternating large-star and small-star
  steps, each written to the shared folder.

Equal fingerprints are one point, so groups of copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurian.llm.sampling import smallest
from tellurian.llm.store import discard, materialise, text_slices

RADIUS = 3
SHINGLE = 3
SAMPLE = 1 << 15
SHARD_POINTS = 8192
#: Nodes with fewer sampled points take a vantage point by rule.
LEAST_SAMPLE = 16
LEAF_POINTS = 48
LEAF_CELLS = 1 << 21


def text_fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """SimHash of lower-cased word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), dtype=np.uint64, count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches, 1):
        texts = b.column(1).cast(pa.binary()).to_pylist()
        found = np.array([text_fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


class TopTree:
    """The sampled top of a vantage-point tree over 32-bit halves."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.vantage = np.zeros((1 << levels) - 1, dtype=np.uint32)
        self.median = np.zeros((1 << levels) - 1, dtype=np.uint8)
        groups = [sample]
        for level in range(levels):
            parts = []
            for at, g in enumerate(groups):
                node = (1 << level) - 1 + at
                if len(g) < LEAST_SAMPLE:
                    v, m = np.uint32(xxhash.xxh32_intdigest(node.to_bytes(8, "little"))), 16
                    d = np.bitwise_count(g ^ v)
                    self.vantage[node], self.median[node] = v, m
                    parts += [g[d <= m], g[d > m]]
                    continue
                v = g[len(g) // 2]
                d = np.bitwise_count(g ^ v)
                m = max(int(np.median(d)), int(d.min()))
                if m >= d.max() and d.min() < d.max():
                    m = int(d.max()) - 1
                self.vantage[node], self.median[node] = v, m
                parts += [g[d <= m], g[d > m]]
            groups = parts

    def route(self, halves: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, shard, at home?) of every shard that a half's ball can reach."""
        rows, nodes, home = np.arange(len(halves)), np.zeros(len(halves), dtype=np.int64), np.ones(len(halves), dtype=bool)
        for level in range(self.levels):
            node = (1 << level) - 1 + nodes
            d = np.bitwise_count(halves[rows] ^ self.vantage[node]).astype(np.int16)
            m = self.median[node].astype(np.int16)
            left, right = d - radius <= m, d + radius > m
            inside = d <= m
            rows, nodes, home = (
                np.concatenate([rows[left], rows[right]]),
                np.concatenate([nodes[left] * 2, nodes[right] * 2 + 1]),
                np.concatenate([(home & inside)[left], (home & ~inside)[right]]),
            )
        yield rows, nodes, home


def _halves(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (fp >> np.uint64(32)).astype(np.uint32), (fp & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _router(trees: list[TopTree], radius: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which, (tree, half) in enumerate(zip(trees, _halves(fp), strict=True)):
                for rows, shard, home in tree.route(half, radius):
                    shard = (shard + which * (1 << tree.levels)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(home), pa.array(fp[rows].view(np.int64))], ["shard", "home", "fp"])

    return route


class Forest:
    """Union-find over positions, smallest position on top."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n, dtype=np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        top = self.up[x]
        while True:
            nxt = self.up[top]
            if np.array_equal(nxt, top):
                return top
            top = nxt

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def search(points: np.ndarray, queries: np.ndarray, all_fp: np.ndarray, half: np.ndarray, reach: int, radius: int, forest: Forest, other: np.ndarray | None = None) -> None:
    """Joins every query to every point within ``radius`` of it, given that their halves differ by ``reach`` at most.

    ``points`` and ``queries`` are positions in ``all_fp``; the vantage-point
    tree is continued on them without being kept.  ``other`` holds the other
    halves, on which points with equal halves are split.
    """
    stack = [(points, queries)]
    while stack:
        pts, qs = stack.pop()
        if not len(pts) or not len(qs):
            continue
        if len(pts) > LEAF_POINTS:
            v = half[pts[len(pts) // 2]]
            dp = np.bitwise_count(half[pts] ^ v).astype(np.int16)
            m = int(np.median(dp))
            if m >= dp.max():
                m = int(dp.max()) - 1
            if m >= dp.min():
                dq = np.bitwise_count(half[qs] ^ v).astype(np.int16)
                stack += [(pts[dp <= m], qs[dq - reach <= m]), (pts[dp > m], qs[dq + reach > m])]
                continue
            if other is not None:
                # All at one distance of a point among them: its halves are equal.
                search(pts, qs, all_fp, other, radius, radius, forest)
                continue
        step = max(1, LEAF_CELLS // len(pts))
        for at in range(0, len(qs), step):
            q = qs[at : at + step]
            near = np.bitwise_count(all_fp[q][:, None] ^ all_fp[pts][None, :]) <= radius
            i, j = np.nonzero(near)
            forest.union(q[i], pts[j])


def _shard_tasks(shards: int, reach: int, radius: int):
    """Edges (fp, root) of each shard; a task's rows come sorted by shard."""

    def solve(shard: int, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        half, other = _halves(fps) if shard < shards else _halves(fps)[::-1]
        forest = Forest(len(fps))
        everything = np.arange(len(fps))
        search(everything[home], everything, fps, half, reach, radius, forest, other)
        top = forest.find(everything)
        linked = top != everything
        return pa.RecordBatch.from_arrays([pa.array(fps[linked].view(np.int64)), pa.array(fps[top[linked]].view(np.int64))], ["a", "b"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fps, homes = None, [], []
        for b in batches:
            shard = b.column(0).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            home = b.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                if lo == hi:
                    continue
                if shard[lo] != current and fps:
                    yield solve(current, np.concatenate(fps), np.concatenate(homes))
                    fps, homes = [], []
                current = shard[lo]
                fps.append(fp[lo:hi])
                homes.append(home[lo:hi])
        if fps:
            yield solve(current, np.concatenate(fps), np.concatenate(homes))

    return tasks


def link_edges(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS, sample: int = SAMPLE) -> DataFrame:
    """a, b: edges that connect distinct fingerprints exactly as all links do."""
    reach = radius // 2
    n = points.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n / shard_points)))))
    rows = smallest(points, sample, "fp", n).collect() if levels else []
    fps = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    trees = [TopTree(h, levels) for h in _halves(fps)]
    routed = points.mapInArrow(_router(trees, reach), "shard int, home boolean, fp long")
    owned = routed.repartitionById(2 << levels, "shard").sortWithinPartitions("shard")
    return owned.mapInArrow(_shard_tasks(1 << levels, reach, radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, for nodes that have edges.

    Alternating large-star and small-star; each round's edges are written to the
    shared folder, and the rounds end when one changes nothing.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc-edges")
    while True:
        # Large star: each node hands its smallest neighbour to its larger ones.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours point to the smallest.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small, "cc-edges")
        # A star forest, and the same one as before: every node's only edge leads to a root.
        deep = after.join(after.select(F.col("u").alias("x")).distinct(), F.col("v") == F.col("x"), "left_semi")
        many = after.groupBy("u").count().where("count > 1")
        discard(e)
        e = after
        if deep.isEmpty() and many.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Documents link where their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id that links reach.  Null and blank texts
    have fingerprint 0 and link like any other.  Null ids are passed over for
    ``component_id``; ids that repeat are rows of their own.  Other columns are
    ignored; an empty table gives an empty result.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = components(link_edges(points.select("fp"), radius))
    grouped = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
