"""Exact quantiles of a large column without sorting it anywhere.

Each pass counts values in bins between the bounds that still hold a wanted rank,
so that what a reducer or the driver holds is a number of bins, whatever the
number of values; when few values are left between the bounds, they are fetched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 2048
FETCH = 20_000


def quantiles(df: DataFrame, value: str, shares: Sequence[float]) -> list[float] | None:
    """Quantiles with linear interpolation between neighbouring ranks; None without any value.

    ``df`` is read once for its extremes and once for each refinement (one or two
    for most data), so give it as a table where it is costly to make.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    found: dict[int, float] = {}
    # Disjoint stretches: least and greatest value, values below it, values in it, ranks wanted of it.
    stretches = [(low, high, 0, n, wanted)]
    while stretches:
        open_ = []
        for a, b, below, count, ranks in stretches:
            if a == b:
                found.update(dict.fromkeys(ranks, a))
            else:
                open_.append((a, b, below, count, ranks))
        if not open_:
            break
        inside = [F.col("v").between(F.lit(a), F.lit(b)) for a, b, *_ in open_]
        near = v.where(_any(inside))
        if sum(s[3] for s in open_) <= FETCH:
            values = sorted(r[0] for r in near.collect())
            at = 0
            for _, _, below, count, ranks in sorted(open_, key=lambda s: s[0]):
                found.update({k: values[at + k - below] for k in ranks})
                at += count
            break
        key = F.lit(None).cast("int")
        for i, (a, b, *_) in reversed(list(enumerate(open_))):
            bin_ = F.least(F.floor((F.col("v") - a) / ((b - a) / BINS)), F.lit(BINS - 1)).cast("int")
            key = F.when(inside[i], i * BINS + bin_).otherwise(key)
        bins = sorted(tuple(r) for r in near.groupBy(key.alias("k")).agg(F.count("v"), F.min("v"), F.max("v")).collect())
        stretches = []
        for i, (_, _, below, _, ranks) in enumerate(open_):
            for k, count, a, b in bins:
                if k // BINS == i:
                    mine = [r for r in ranks if below <= r < below + count]
                    if mine:
                        stretches.append((a, b, below, count, mine))
                    below += count
    ends = [(found[int(p)], found[min(int(p) + 1, n - 1)], p - int(p)) for p in places]
    return [a + (b - a) * part for a, b, part in ends]


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
