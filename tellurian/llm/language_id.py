"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a whole text byte by byte (ASCII letters in lower case), once
forwards and once backwards, and labels every position with a distribution over
the languages; a document's distribution is the mean over the positions of its
letters.  It is trained in numpy by backpropagation through time on stretches of
a bounded, hash-chosen sample of labelled documents.

A text of any length is read in chunks, each with ``CONTEXT`` bytes of its
neighbours on either side, over which the state is warmed up but nothing is
labelled: the state is carried across words but begins anew with each chunk's
context, while the chunks of many texts advance side by side.  Every text is
answered on its own; no other text has a share in its states.

A softmax shares all of its mass among the languages that it knows, whatever it
reads.  :class:`Statistics` says how likely the letters of a text are in any of
them, so that a caller can turn away what is none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.llm.sampling import SAMPLE_BYTES, fold, smallest_of_each, texts_of
from tellurian.llm.store import text_slices

HIDDEN = 16
STEPS = 250
BATCH = 128
#: Bytes of a training example.
STRETCH = 96
#: Labelled bytes of a chunk, and bytes on either side that it reads besides.
CHUNK = 480
CONTEXT = 32
#: Chunks that advance together.
ROWS = 1536
SAMPLE_DOCS = 1000
UNDETERMINED = "und"

#: ASCII letters in lower case; every other byte stays.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_LETTER = np.array([c >= 128 or 97 <= c <= 122 for c in range(256)])


def _bytes_of(text: bytes) -> np.ndarray:
    return np.frombuffer(text.translate(_LOWER), np.uint8)


def _squash(x: np.ndarray) -> np.ndarray:
    """Softsign, from -1 to 1: the shape of tanh at a fifth of its price."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of :func:`_squash` where it is ``y``."""
    return (1 - np.abs(y)) ** 2


def _squash_in(x: np.ndarray, room: np.ndarray) -> None:
    np.abs(x, out=room)
    room += np.float32(1)
    x /= room


class Gru:
    """Two gated recurrent layers, one each way, and a position-wise softmax."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"out": init(2 * hidden, len(languages)), "bias": np.zeros(len(languages), np.float32)}
        for way in ("f", "b"):
            self.p[f"x{way}"] = (rng.normal(0, 0.3, (256, 3 * hidden))).astype(np.float32)
            self.p[f"u{way}"] = init(hidden, 2 * hidden)
            self.p[f"c{way}"] = init(hidden, hidden)

    def layer(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States of one direction, (time, batch, hidden); ``x`` is (batch, time) bytes in reading order."""
        p, hid = self.p, self.hidden
        h = np.zeros((len(x), hid), np.float32)
        states = np.empty((x.shape[1], len(x), hid), np.float32)
        for t in range(x.shape[1]):
            given = p[f"x{way}"][x[:, t]]
            gates = 0.5 + 0.5 * _squash(given[:, : 2 * hid] + h @ p[f"u{way}"])
            z, r = gates[:, :hid], gates[:, hid:]
            inner = h @ p[f"c{way}"]
            n = _squash(given[:, 2 * hid :] + r * inner)
            if keep is not None:
                keep.append((h, z, r, inner, n))
            h = n + z * (h - n)
            states[t] = h
        return states

    def probabilities(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, batch, language): the label distribution of every position."""
        forward, backward = ([], []) if keep is not None else (None, None)
        f = self.layer(x, "f", forward)
        b = self.layer(x[:, ::-1], "b", backward)[::-1]
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        e /= e.sum(axis=2, keepdims=True)
        if keep is not None:
            keep.update(forward=forward, backward=backward, both=both)
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients: cross-entropy at every position, backpropagated through time."""
        keep: dict = {}
        prob = self.probabilities(x, keep)
        steps, n = prob.shape[:2]
        loss = -float(np.log(prob[:, np.arange(n), y] + 1e-9).mean())
        d = prob
        d[:, np.arange(n), y] -= 1
        d /= steps * n
        flat = d.reshape(steps * n, -1)
        g = {"out": keep["both"].reshape(steps * n, -1).T @ flat, "bias": flat.sum(axis=0)}
        dboth = d @ self.p["out"].T
        for way, cached, dstates, seen in (("f", keep["forward"], dboth[:, :, : self.hidden], x), ("b", keep["backward"], dboth[::-1, :, self.hidden :], x[:, ::-1])):
            u, c = self.p[f"u{way}"], self.p[f"c{way}"]
            dh = np.zeros_like(dstates[0])
            before, dinners, dgiven = (np.empty((steps, n, k * self.hidden), dh.dtype) for k in (1, 1, 3))
            for t in range(steps - 1, -1, -1):
                h, z, r, inner, cand = cached[t]
                dh = dh + dstates[t]
                dn = dh * (1 - z) * _slope(cand)
                dinner = dn * r
                dgates = np.concatenate([dh * (h - cand) * 0.5 * _slope(2 * z - 1), dn * inner * 0.5 * _slope(2 * r - 1)], axis=1)
                before[t], dinners[t] = h, dinner
                dgiven[t, :, : 2 * self.hidden], dgiven[t, :, 2 * self.hidden :] = dgates, dn
                dh = dh * z + dgates @ u.T + dinner @ c.T
            past, given = before.reshape(steps * n, -1).T, dgiven.reshape(steps * n, -1)
            read = np.ascontiguousarray(seen.T).reshape(-1)
            order = np.argsort(read, kind="stable")
            kinds, starts = np.unique(read[order], return_index=True)
            gx = np.zeros_like(self.p[f"x{way}"])
            gx[kinds] = np.add.reduceat(given[order], starts)
            g |= {f"x{way}": gx, f"u{way}": past @ given[:, : 2 * self.hidden], f"c{way}": past @ dinners.reshape(steps * n, -1)}
        return loss, g

    def logits(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(position, language): labels before the softmax, of all sequences ``flat[begin:begin + size]``.

        Sequences come longest first, so that those which go on are always the
        first ones; the bytes are laid out step by step.  A gate is half a squashed
        value and one half, and of the reset gate that half goes into the weights.
        """
        hid, p = self.hidden, self.p
        going = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        edge = np.concatenate([[0], np.cumsum(going)])
        step = np.repeat(np.arange(len(going)), going)
        who = np.arange(len(flat)) - edge[step]
        out = np.tile(p["bias"], (len(flat), 1))
        half = np.float32(0.5)
        for way, place in (("f", begin[who] + step), ("b", begin[who] + (sizes[who] - 1 - step))):
            read = flat[place].astype(np.intp)
            tables = [np.ascontiguousarray(p[f"x{way}"][:, k * hid : (k + 1) * hid]) for k in range(3)]
            inward = [np.ascontiguousarray(w) for w in (p[f"u{way}"][:, :hid], p[f"u{way}"][:, hid:], p[f"c{way}"] * half)]
            outward = p["out"][:hid] if way == "f" else p["out"][hid:]
            h = np.zeros((len(sizes), hid), np.float32)
            room = np.empty((5, len(sizes), hid), np.float32)
            found = np.empty((len(flat), out.shape[1]), np.float32)
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                n, x = hi - lo, read[lo:hi]
                state, z, r, new, m, c = h[:n], *(a[:n] for a in room)
                for gate, k in ((z, 0), (r, 1)):
                    np.take(tables[k], x, axis=0, out=gate, mode="clip")
                    np.matmul(state, inward[k], out=m)
                    gate += m
                    _squash_in(gate, m)
                np.take(tables[2], x, axis=0, out=new, mode="clip")
                np.matmul(state, inward[2], out=c)
                new += c
                r *= c
                new += r
                _squash_in(new, m)
                np.subtract(state, new, out=m)
                m *= z
                state += new
                state += m
                state *= half
                np.matmul(state, outward, out=found[lo:hi])
            out[place] += found
        return out

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean distribution over the letters of each text; zeros without letters."""
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        chunks = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), CHUNK)]
        read = [_bytes_of(t) for t in texts]
        for lo in range(0, len(chunks), ROWS):
            some = [(i, at, max(0, at - CONTEXT), min(len(texts[i]), at + CHUNK + CONTEXT)) for i, at in chunks[lo : lo + ROWS]]
            some.sort(key=lambda c: c[2] - c[3])
            flat = np.concatenate([read[i][a:b] for i, _, a, b in some])
            sizes = np.array([b - a for _, _, a, b in some])
            begin = np.cumsum(sizes) - sizes
            e = np.exp(np.clip(self.logits(flat, begin, sizes), -40, 40))
            # Letters of the chunk itself, not of its context.
            inside = np.arange(len(flat)) - np.repeat(begin, sizes)
            skip = np.array([at - a for _, at, a, _ in some])
            counts = _IS_LETTER[flat] & (inside >= np.repeat(skip, sizes)) & (inside < np.repeat(skip + CHUNK, sizes))
            e *= (counts / (e @ np.ones(e.shape[1], np.float32)))[:, None].astype(np.float32)
            owner = [i for i, *_ in some]
            np.add.at(total, owner, np.add.reduceat(e, begin, axis=0))
            np.add.at(letters, owner, np.add.reduceat(counts, begin, dtype=np.int64))
        return total / np.maximum(letters, 1)[:, None]

    def fit(self, stretches: list[np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = 0.015, seed: int = 11) -> list[float]:
        """Adam over batches of equal shares of the languages; ``stretches`` has an array (example, byte) of each."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            y = np.arange(max(batch, len(stretches))) % len(stretches)
            x = np.stack([stretches[k][rng.integers(len(stretches[k]))] for k in y])
            loss, g = self.gradients(x, y)
            losses.append(loss)
            now = rate * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-4
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses


def examples(texts: list[bytes], rng: np.random.Generator, most: int = 4000) -> np.ndarray:
    """(example, byte): stretches of equal length from anywhere in the texts, long texts giving more; short ones repeat with a blank between."""
    out = []
    share = np.array([len(t) for t in texts], float)
    for i in rng.choice(len(texts), most, p=share / share.sum()):
        t = texts[i]
        if len(t) < STRETCH:
            t = (t + b" ") * (STRETCH // (len(t) + 1) + 1)
        at = int(rng.integers(len(t) - STRETCH + 1))
        out.append(_bytes_of(t[at : at + STRETCH]))
    return np.stack(out)


def train(rows: list[tuple[str, str]], **fit) -> Gru | None:
    """A network from (text, language) rows; None without any letter to learn from."""
    texts: dict[str, list[bytes]] = {}
    for text, language in rows:
        if any(map(str.isalpha, text)):
            texts.setdefault(language, []).append(text.encode())
    if not texts:
        return None
    rng = np.random.default_rng(3)
    net = Gru(sorted(texts))
    if len(texts) > 1:
        net.fit([examples(texts[k], rng) for k in net.languages], **fit)
    return net


#: Letters that are told apart; all other bytes are one more.
KINDS = 62
#: Every so many sampled rows are kept from the counts, and their scores set the bound.
CALIBRATE = 5
#: A text is familiar if its score is no lower than this quantile of those, less so many nats a letter.
QUANTILE = 0.002
ROOM = 1.5


class Statistics:
    """Log-likelihood a letter byte of a text, each word in the learned language that explains it best.

    A byte's chance follows from the two before it in its word, smoothed with one
    and with none; bytes that are no letters, digits too, only end words.  Words
    go by their own best language, so that a text of two learned languages is
    familiar.
    """

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        held, counted = rows[::CALIBRATE], [r for i, r in enumerate(rows) if i % CALIBRATE]
        share = np.zeros(256, np.int64)
        for text, _ in counted:
            share += np.bincount(_bytes_of(text.encode()), minlength=256)
        share[~_IS_LETTER] = 0
        own = np.argsort(-share, kind="stable")[:KINDS]
        own = own[share[own] > 0]
        # Kind 0 ends a word, 1 is any other letter byte.
        self.kind = np.where(_IS_LETTER, 1, 0).astype(np.int64)
        self.kind[own] = np.arange(2, 2 + len(own))
        self.kinds = 2 + len(own)
        others = max(1, int(_IS_LETTER.sum()) - len(own))
        languages = sorted({k for _, k in counted})
        self.tables = np.stack([self._table([t for t, k in counted if k == language], others) for language in languages]) if languages else np.zeros((0, 0), np.float32)
        scores = self.score([t.encode() for t, _ in held]) if languages else np.zeros(0)
        scores = scores[np.isfinite(scores)]
        self.bound = float(np.quantile(scores, QUANTILE)) - ROOM if len(scores) else -np.inf

    def _places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context and letter as one number, whether a word begins, text) of every letter byte."""
        z = self.kind[_bytes_of(b" ".join(texts) + b" ")]
        one = np.concatenate([[0], z[:-1]])
        two = np.concatenate([[0, 0], z[:-2]])[: len(z)] * (one > 0)
        at = np.flatnonzero(z)
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        return ((two * self.kinds + one) * self.kinds + z)[at], one[at] == 0, owner[at]

    def _table(self, texts: list[str], others: int) -> np.ndarray:
        k = self.kinds
        three = np.zeros(k**3)
        for text in texts:
            three += np.bincount(self._places([text.encode()])[0], minlength=k**3)
        three = three.reshape(k, k, k)
        two = three.sum(axis=0)
        one = two.sum(axis=0) + 0.5
        one[0] = 0
        p = one / one.sum()
        for counts in (two, three):
            p = (counts + 4 * p) / (counts.sum(axis=-1, keepdims=True) + 4)
        p[..., 1] /= others
        return np.log(np.maximum(p, 1e-30)).astype(np.float32).reshape(-1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """One number for each text; minus infinity for a text without letters, 0 for others where nothing was learned."""
        out = np.full(len(texts), -np.inf)
        at, begins, owner = self._places(texts)
        if not len(at):
            return out
        words = np.flatnonzero(begins)
        # Where nothing was learned every letter is as good as any other.
        best = np.zeros(len(words)) if not len(self.tables) else np.max([np.add.reduceat(t[at].astype(np.float64), words) for t in self.tables], axis=0)
        n = np.bincount(owner, minlength=len(texts))
        total = np.bincount(owner[words], best, minlength=len(texts))
        out[n > 0] = total[n > 0] / n[n > 0]
        return out


def _held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def sample_rows(docs: DataFrame, sample: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """(text, language) of ``sample`` labelled rows of each language outside the held-out fold (crc32 of the id as text, mod 4 = 2).

    An id that the sample has in two languages teaches nothing.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    open_rows = d.select("doc_id", "lang").where(~_held_out(F.col("doc_id"))).where("lang IS NOT NULL")
    drawn = smallest_of_each(open_rows, sample, "lang")
    chosen = drawn.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other").drop("other")
    return [(r.text, r.lang) for r in texts_of(d, chosen, most_bytes) if r.text]


def fit_on(docs: DataFrame, sample: int = SAMPLE_DOCS, **columns) -> Gru | None:
    """A network from :func:`sample_rows`."""
    return train(sample_rows(docs, sample, **columns))


def identify(docs: DataFrame, net: Gru | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), pred: str = "lang_pred", score: str = "score", known: tuple[str, Statistics] | None = None) -> DataFrame:
    """doc_id (or the columns in ``keep``), then ``pred`` and ``score``, and with ``known`` = (name, statistics) whether the text is familiar.

    ``und`` with score 0 for a null text or one without a letter (or where there
    was nothing to learn from).  Ties go to the first language by code point.
    Only the text is read for a prediction; every row is answered on its own, so
    rows that repeat get the same answer; an empty table gives an empty result.
    Where a column in ``keep`` has the name of an added one, rename the latter.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((net, known[1] if known else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, statistics = shared.value
        for b in text_slices(batches, "__text"):
            texts = b.column("__text").to_pylist()
            lettered = np.array([bool(t) and model is not None and any(map(str.isalpha, t)) for t in texts], bool)
            if lettered.any():
                prob = model.pool([t.encode() if ok else b"" for t, ok in zip(texts, lettered, strict=True)])
                best = prob.argmax(axis=1)
                found = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered, strict=True)]
                sure = np.clip(np.where(lettered, prob.max(axis=1), 0), 0, 1)
            else:
                found, sure = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rest = [b.column(i) for i in range(b.num_columns - 1)]
            added = {"lang": pa.array(found, pa.string()), "score": pa.array(sure, pa.float64())}
            if statistics is not None:
                added["known"] = pa.array(statistics.score([(t or "").encode() for t in texts]) >= statistics.bound)
            yield pa.RecordBatch.from_arrays([*rest, *added.values()], [*b.schema.names[:-1], *added])

    names = keep or ("doc_id",)
    columns = [F.col(f"`{c}`") for c in keep] or [F.col(id_col)]
    # Inner names, since a kept one may hold anything.
    given = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    if known:
        return given.mapInArrow(run, f"{fields}, lang string, score double, known boolean").toDF(*names, pred, score, known[0])
    return given.mapInArrow(run, f"{fields}, lang string, score double").toDF(*names, pred, score)


def language_id(docs: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trains on the open folds and identifies every row."""
    found = identify(docs, fit_on(docs, sample))
    return found.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
