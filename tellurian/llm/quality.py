"""Quality classifier: a factorisation machine over hashed words and text structure.

score(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

which is all pairwise interactions in time linear in the number of features.
Features are words hashed into 2**16 slots (counts, scaled to length one) and
structure statistics and metadata of the text (length, shares of capitals,
digits, symbols, separators, repetition, word and line lengths), cut into bins
so that each bin is a feature of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurian.llm.sampling import fold, labelled_texts
from tellurian.llm.store import text_slices

SLOTS = 1 << 16
BINS = 12
RANK = 8
SAMPLE_PER_CLASS = 2500
EPOCHS = 6
CACHE_WORDS = 500_000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 6))
for _c in range(256):
    _CLASSES[_c] = (65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, _c >= 128, _c in b" \t\r\n\x0b\x0c", 33 <= _c <= 126 and not chr(_c).isalnum())
STATISTICS = 12


def statistics(text: bytes, words: int, distinct: int) -> np.ndarray:
    """Structure statistics, each in 0..1."""
    n = max(len(text), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, wide, space, symbol = counts @ _CLASSES / n
    letters = max(upper + lower + wide, 1e-9)
    lines = counts[10] + 1
    w = max(words, 1)
    return np.array([
        min(np.log1p(len(text)) / 14, 1), upper / letters, digit, wide, space, symbol,
        min(counts[124] / w, 1), min((counts[33] + counts[63]) / w, 1), min((counts[46] + counts[44]) / w, 1),
        distinct / w, min(len(text) / w / 20, 1), min(np.log1p(len(text) / lines) / 10, 1),
    ])


class Features:
    """Feature lists of texts; word hashes are kept while a worker lives."""

    size = SLOTS + STATISTICS * BINS

    def __init__(self) -> None:
        self.slot: dict[bytes, int] = {}

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values) of one whole text."""
        if len(self.slot) > CACHE_WORDS:
            self.slot.clear()
        known = self.slot
        words = text.split()
        slots = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = zlib.crc32(w) & (SLOTS - 1)
            slots[i] = s
        ids, counts = np.unique(slots, return_counts=True)
        values = counts / max(np.sqrt((counts.astype(float) ** 2).sum()), 1)
        bins = np.minimum(statistics(text, len(words), len(ids)) * BINS, BINS - 1).astype(np.int64) + np.arange(STATISTICS) * BINS + SLOTS
        return np.concatenate([ids, bins]), np.concatenate([values, np.full(STATISTICS, 0.5)])


class FactorisationMachine:
    """Second-order factorisation machine with a logistic output."""

    def __init__(self, size: int, rank: int = RANK, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(size, np.float32)
        self.v = rng.normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, ids: np.ndarray, x: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of ``n`` texts before the logistic, and their factor sums."""
        vx = self.v[ids] * x[:, None]
        sums = np.stack([np.bincount(owner, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(owner, (vx * vx).sum(axis=1), n)
        return self.bias + np.bincount(owner, self.w[ids] * x, n) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, ids: np.ndarray, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(ids, x, owner, n)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 9) -> None:
        """AdaGrad on the logistic loss, both classes weighing the same."""
        rng = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        gw, gv = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                ids, x = (np.concatenate([rows[i][k] for i in some]) for k in range(2))
                raw, sums = self.raw(ids, x, owner, len(some))
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) * weight[some] / len(some)
                each = (err[owner] * x).astype(np.float32)
                dv = each[:, None] * (sums[owner] - self.v[ids] * x[:, None])
                touched, inverse = np.unique(ids, return_inverse=True)
                dw = np.bincount(inverse, each) + decay * self.w[touched]
                dv = np.stack([np.bincount(inverse, dv[:, f]) for f in range(dv.shape[1])], axis=1) + decay * self.v[touched]
                gw[touched] += dw**2
                gv[touched] += dv**2
                self.w[touched] -= rate * dw / np.sqrt(gw[touched])
                self.v[touched] -= rate * dv / np.sqrt(gv[touched])
                self.bias -= rate * err.sum()


def train(rows: list[tuple[str, int]], **fit) -> FactorisationMachine:
    """A machine from (text, 0 or 1) rows; without both classes it answers with the share of ones, or 0.5."""
    features = Features()
    machine = FactorisationMachine(Features.size)
    labels = np.array([y for _, y in rows], float)
    if len(set(labels)) == 2:
        machine.fit([features.of(t.encode()) for t, _ in rows], labels, **fit)
    elif len(labels):
        machine.bias = 4.0 if labels[0] else -4.0
    return machine


_FEATURES = Features()


def score_texts(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score in 0..1 of every whole text; a null text counts as empty, rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            rows = [_FEATURES.of((t or "").encode()) for t in b.column(1).to_pylist()]
            if rows:
                owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
                score = shared.value.score(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), owner, len(rows))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score.astype(float))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Learns from at most ``per_class`` labelled rows of each class outside the
    held-out fold (crc32 of the id as text, mod 5 = 0).  Documents without a
    label are scored all the same; without any label every score is 0.5.  Null
    texts count as empty; extra columns are ignored; an empty table gives an
    empty result.
    """
    machine = train(labelled_texts(docs, labels, "quality", fold(F.col("doc_id"), 5) == 0, per_class))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_texts(docs, machine).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
