"""Runs of periodic words, by power-of-two naming in numpy inside tasks.

Naming in the manner of Karp, Miller and Rosenberg: on level 0 equal words have
equal numbers; the name of the 2**k words that begin at a place is the rank of
the pair of names of their halves.  A place whose name nothing shares keeps a
name of its own on all higher levels, so that only repeats are named again.
The longest common extension of two places is read off level by level, from the
highest down.  No text is hashed and no suffixes are sorted.

A run of period q has at least 3 q places p at which word p equals word p + q.
They hold a multiple of 2 q after which q more of them follow, so that places on
that grid whose names of 2**k <= q words equal those q words on are all the
candidates; each is extended both ways.  A stretch that is found under several
periods has the least of them.

Many texts are laid end to end and worked on together; a pair of places in
different texts is no candidate, and words between texts equal no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.llm.store import text_slices

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Bytes of text that are worked on together; one longer text is worked on alone.
LAID_BYTES = 1 << 20


@dataclass
class Runs:
    """Start, length and period of runs, in order of start and period."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray

    def between(self, lo: int, hi: int) -> Runs:
        """Those that start from ``lo`` on and before ``hi``, counted from ``lo``."""
        a, b = np.searchsorted(self.start, [lo, hi])
        return Runs(self.start[a:b] - lo, self.length[a:b], self.period[a:b])


def names_of(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names by level for blocks of 1, 2, 4 ... words, up to ``longest``; ``words`` holds numbers from 0.

    Places where a block would run over the end, and places that share their name
    with no other, have names that occur once.
    """
    n = len(words)
    count = np.bincount(words) if n else np.zeros(0, np.int64)
    shared = np.flatnonzero(count[words] > 1) if n else np.zeros(0, np.int64)
    # Shared names are below n; the own name of a place is n + place.
    own = np.arange(n, 2 * n, dtype=np.int64)
    level = own.copy()
    level[shared] = np.unique(words[shared], return_inverse=True)[1]
    levels = [level]
    size = 1
    while 2 * size <= longest and len(shared):
        low = levels[-1]
        at = shared[shared + size < n]
        at = at[low[at + size] < n]
        _, name, times = np.unique(low[at] * n + low[at + size], return_inverse=True, return_counts=True)
        again = times[name] > 1
        level = own.copy()
        shared = at[again]
        level[shared] = name[again]
        levels.append(level)
        size *= 2
    return levels


def extensions(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``i`` on (or before ``i``) equal those from (before) ``j``, ``i`` < ``j``, by descending levels.

    A highest level may match many times, so it is tried until no pair moves.
    """
    n = len(levels[0])
    moved = np.zeros(len(i), np.int64)
    going = np.arange(len(i))
    for k in range(len(levels) - 1, -1, -1):
        size, top = 1 << k, k == len(levels) - 1
        live = going
        while len(live):
            a, b = (i[live] + moved[live], j[live] + moved[live]) if forward else (i[live] - moved[live] - size, j[live] - moved[live] - size)
            inside = (b < n) if forward else (a >= 0)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[levels[k][a] == levels[k][b]]
            moved[live] += size
            if not top:
                break
    return moved


def find_runs(words: np.ndarray, text: np.ndarray) -> Runs:
    """All runs of length >= max(6, 4 q); ``text`` numbers the text of each place, rising from 0 on."""
    n = len(words)
    sizes = np.bincount(text) if n else np.zeros(0, np.int64)
    longest = int(sizes.max(initial=0))
    levels = names_of(words, longest)
    first = np.cumsum(sizes) - sizes
    found: list[np.ndarray] = []
    held = 0
    # The run that holds a place, of those that are long enough to be found again under multiples of their period.
    holder, held_period = np.full(n, -1), [1]
    for q in range(1, longest // LEAST_EXPONENT + 1):
        k = q.bit_length() - 1
        if k >= len(levels):
            break  # no block of q words occurs twice
        g = np.arange(0, n - q, 2 * q)
        g = g[levels[k][g] == levels[k][g + q]]
        g = g[text[g] == text[g + q]]
        if len(g) and len(held_period) > 1:
            known = holder[g]
            g = g[(known < 0) | (known != holder[g + q]) | (q % np.array(held_period)[known] != 0)]
        if not len(g):
            continue
        g, hi = _leading(levels, g, q, first[text[g]] + sizes[text[g]])
        lo = np.maximum(g - extensions(levels, g, g + q, False), first[text[g]])
        ok = hi - lo >= max(LEAST_LENGTH, LEAST_EXPONENT * q)
        if ok.any():
            for a, b in zip(lo[ok].tolist(), hi[ok].tolist(), strict=True):
                if b - a >= 2 * LEAST_EXPONENT * q:
                    holder[a:b] = len(held_period)
                    held_period.append(q)
            found.append(np.stack([lo[ok], hi[ok] - lo[ok], np.full(int(ok.sum()), q)], axis=1))
            held += len(found[-1])
            if held > 2 * n:
                found = [_least(np.concatenate(found))]
                held = len(found[0])
    if not found:
        return Runs(*np.zeros((3, 0), np.int64))
    return Runs(*_least(np.concatenate(found)).T)


def _leading(levels: list[np.ndarray], g: np.ndarray, q: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the grid places ``g`` those that no stretch from an earlier one reaches, and where their stretches end.

    A stretch ends where its text does (``end``).  In a row of adjacent places the
    first one is extended, what it reaches is left out, and so on; places that are
    left after a few rounds are extended together.
    """
    kept, ends = [], []
    for last in (False, False, False, True):
        head = np.ones(len(g), bool) if last else np.concatenate([[True], np.diff(g) != 2 * q])
        h = g[head]
        hi = np.minimum(h + extensions(levels, h, h + q, True) + q, end[head])
        kept.append(h)
        ends.append(hi)
        left = g >= (hi - q)[np.cumsum(head) - 1]
        g, end = g[left], end[left]
        if last or not len(g):
            break
    return np.concatenate(kept), np.concatenate(ends)


def _least(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with the same stretch that with the least period, by start and period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def numbered(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, number of its text) of the texts laid end to end; equal words have equal numbers."""
    seen: dict = {}
    words = np.array([seen.setdefault(w, len(seen)) for t in texts for w in t], np.int64)
    return words, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def dropped(runs: Runs, n: int) -> np.ndarray:
    """Whether any run holds a word after the run's first period, for each of ``n`` words."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs.start + runs.period, 1)
    np.add.at(edge, runs.start + runs.length, -1)
    return np.cumsum(edge[:-1]) > 0


def made_periodic(words: list, h: int | None) -> list:
    """The probe's words: for one id in ten, its hash ``h`` makes the words from a place on repeat.

    With g = h // 10, word i >= a = g % n becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8).  Other words, and those of a null id, stay.
    """
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


_COLUMNS = [("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string"), ("collapsed", "string"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>")]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _row(words: list[bytes], runs: Runs, whole: bool) -> tuple:
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True))
    if len(runs.start):
        gone = dropped(runs, len(words))
        left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        top = np.lexsort((runs.period, runs.start, -runs.length))[0]
        s, m, p = (int(x[top]) for x in (runs.start, runs.length, runs.period))
        best = (s, m, p, 1000 * m // p)
    else:
        left, best = b" ".join(words), (None, None, None, None)
    out = (len(runs.start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
    if not whole:
        return out
    spans = [{"start": s, "length": m, "period": p} for s, m, p in zip(runs.start.tolist(), runs.length.tolist(), runs.period.tolist(), strict=True)]
    return (*out, left.decode(), spans)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", probe: Column | None = None, whole: bool = True) -> DataFrame:
    """doc_id, n_runs, the longest run, digests and, if ``whole``, the text without repeats (``collapsed``) and all ``runs``.

    Words are maximal stretches without ASCII blanks, numbered from 0.  A run is a
    stretch with smallest period q of length >= max(6, 4 q) that neither
    neighbouring word extends.  The longest run comes with ``exponent_milli`` =
    floor(1000 * length / period); ties go to the smaller start; four nulls
    without a run.  ``collapsed`` has the words that no run holds after its first
    period, joined by one blank.

    A null or blank text has no words, no run and an empty collapse.  Texts are
    read whole, each row on its own: rows that repeat are answered alike, null
    ids stay null, other columns are not read, an empty table gives an empty
    result.  ``probe`` is a column of hashes for :func:`made_periodic`, or none.
    """
    columns = _COLUMNS if whole else _COLUMNS[:-2]
    given = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.lit(None).cast("long") if probe is None else probe.cast("long")).alias("__probe"), F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string()}
        for b in text_slices(batches, "__text", LAID_BYTES):
            # bytes.split() splits at the six ASCII blanks.
            texts = [made_periodic((t or "").encode().split(), h) for t, h in zip(b.column("__text").to_pylist(), b.column("__probe").to_pylist(), strict=True)]
            words, text = numbered(texts)
            runs = find_runs(words, text)
            ends = np.cumsum([len(t) for t in texts]).tolist()
            out = [_row(t, runs.between(end - len(t), end), whole) for t, end in zip(texts, ends, strict=True)]
            arrays = [pa.array(v, kinds.get(kind) or pa.list_(_RUN)) for v, (_, kind) in zip(zip(*out, strict=True), columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *[n for n, _ in columns]])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {k}" for n, k in columns))


def run_probe(docs: DataFrame) -> DataFrame:
    """The digests of :func:`periodic_runs` over texts of which one in ten is made periodic by its id's crc32."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic_runs(docs, probe=h, whole=False)
