"""Toxicity: a lexicon trie read through Levenshtein automata, weighed by context.

Terms and stems are learned from labelled documents by their log-odds and kept in
one trie.  Reading a word against the trie with up to two errors is the
intersection of the word's Levenshtein automaton with the trie; its states are
sets of (trie node, errors) pairs, built on demand and kept, so that most words
die within three letters at the price of a dictionary look-up each.

Words are letter runs.  Where a token holds digits or symbols, or single letters
follow one another, it is also read whole, inner signs counting as letters, and
with its signs left out; such a reading replaces its letter runs where it is
nearer to the lexicon than they are.

A hit is then judged in its window: inside a pair of quotation marks, or beside
words that report speech, it counts as quotation; otherwise as abuse, more so
when hits crowd together or address the reader.  A mark that is never closed, or
closed too far away, quotes nothing.  A logistic model over these sums gives
the document's score.
"""

from __future__ import annotations

import math
import re
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellurian.llm.sampling import fold, labelled_texts
from tellurian.llm.store import text_slices

SAMPLE_PER_CLASS = 3000
WINDOW = 6
MIN_CONTEXTS = 8
MIN_ODDS = 20.0
STEM_LENGTHS = (4, 5, 6)
STEM_WORDS = 8
CACHE_WORDS = 400_000

#: Words that report speech and words that address the reader, in the four languages of the corpus.
REPORTING = frozenset("said says say wrote writes called calls quote quoted word term slur dit dire mot écrit appelle cité sagte sagt schrieb nannte wort zitat dijo dice escribió llamó palabra cita".split())
ADDRESS = frozenset("you your youre u tu vous ton votre toi du dich dein ihr euch tú vos usted ustedes".split())
QUOTES = "\"“”«»„‟"
#: A quotation that is not closed within so many characters is none.
QUOTE_REACH = 600

_WORD = re.compile(r"[^\W\d_]+")
_QUOTE = re.compile(f"[{QUOTES}]")
_OUTER = string.punctuation + "“”«»„‟‘’…–—¡¿·"
_SIGNS = re.compile(r"[\W_]+")
#: Whole tokens, their parts between joints, and runs of single letters, digits among them.
_TOKEN = re.compile(r"\S+")
_PART = re.compile(r"[^\s\-'’/.,;:…()\[\]{}<>|\\–—?\"“”«»„‟]+")
_SPELT = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]{1,3}[^\W_](?![^\W_])){2,}")


def allowed_errors(length: int) -> int:
    """Errors that a term of this length may be read with."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Terms and stems with weights, in a trie that is read with errors."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float]) -> None:
        self.terms, self.stems = terms, stems
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[str | None] = [None]
        self.stem_at: list[str | None] = [None]
        for words, ends in ((terms, self.term_at), (stems, self.stem_at)):
            for word in sorted(words):
                node = 0
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.term_at.append(None)
                        self.stem_at.append(None)
                    node = self.children[node][c]
                ends[node] = word
        self.most = max((allowed_errors(len(w)) for w in terms), default=0)
        self._numbers: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._hit: list[tuple[str, int, bool] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Number of a state: closed under skipped trie letters, each node at its fewest errors."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.most:
                todo += [(child, e + 1) for child in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self._numbers:
            self._numbers[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            hits = [(e, self.term_at[n]) for n, e in key if self.term_at[n] is not None and e <= allowed_errors(len(self.term_at[n]))]
            self._hit.append(min(hits) if hits else None)
        return self._numbers[key]

    def _step(self, state: int, c: str) -> int:
        """Reads one letter; -1 if no term can be reached any more."""
        pairs = set()
        for node, e in self._sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    pairs.add((child, e))
                elif e < self.most:
                    pairs.add((child, e + 1))
            if e < self.most:
                pairs.add((node, e + 1))
        to = self._state(pairs) if pairs else -1
        if to >= 0 and len(self._sets) > 200_000:  # the states of odd words would pile up
            self._numbers, self._sets, self._next, self._hit = {}, [], [], []
            self.start = self._state({(0, 0)})
            return self._state(pairs)
        if state < len(self._next):
            self._next[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """(term or stem, errors) of a word, nearest first; None if it is not in the lexicon."""
        node = 0
        for c in word:
            node = self.children[node].get(c)
            if node is None:
                break
            if self.stem_at[node] is not None:
                return self.stem_at[node], 0
        state = self.start
        for c in word:
            found = self._next[state].get(c)
            state = self._step(state, c) if found is None else found
            if state < 0:
                return None
        hit = self._hit[state]
        return (hit[1], hit[0]) if hit else None

    def weight(self, entry: str) -> float:
        return max(self.terms.get(entry, 0.0), self.stems.get(entry, 0.0))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def quoted_spans(text: str, reach: int = QUOTE_REACH) -> list[tuple[int, int]]:
    """(start, end) between paired quotation marks.

    A mark opens where a word follows and none ends before it, and closes where
    it is the other way round, so that an inch sign opens nothing; between two
    blanks its shape decides.  The last mark that opened is the one that closes.
    """
    spans, at = [], None
    for m in _QUOTE.finditer(text):
        here = m.start()
        before, after = text[here - 1 : here] if here else " ", text[here + 1 : here + 2] or " "
        bound, free = before.isspace() or before in "([{-–—:", not after.isspace() and after not in ")]}.,;:!?"
        opens = m.group() in "«„“" or (m.group() == '"' and at is None) if bound and not free else bound and free
        if opens:
            at = here
        elif at is not None:
            if here - at <= reach:
                spans.append((at, here))
            at = None
    return spans


def learn_lexicon(rows: list[tuple[str, int]]) -> Lexicon:
    """Terms and stems that toxic documents hold far more often than others.

    A word counts once for each different word before it, so that copies of one
    document do not make its words into evidence.
    """
    toxic: dict[str, set[str]] = {}
    other, n = Counter(), [0, 0]
    for text, label in rows:
        n[label] += 1
        words = words_of(text)
        if label:
            for before, w in zip(["", *words], words, strict=False):
                toxic.setdefault(w, set()).add(before)
        else:
            other.update(set(words))
    odds = lambda t, o: ((t + 0.5) / (n[1] + 1)) / ((o + 0.5) / (n[0] + 1))
    terms = {w: math.log(odds(len(b), other[w])) for w, b in toxic.items() if len(b) >= MIN_CONTEXTS and len(w) > 2 and odds(len(b), other[w]) >= MIN_ODDS}
    stems: dict[str, float] = {}
    for length in STEM_LENGTHS:
        spread: dict[str, set[str]] = {}
        inside, outside = Counter(), Counter()
        for w, b in toxic.items():
            if len(w) > length:
                spread.setdefault(w[:length], set()).update(b)
                inside[w[:length]] += 1
        for w in other:
            if len(w) > length:
                outside[w[:length]] += other[w]
        for stem, before in spread.items():
            # A stem that shows in many different words and contexts, of toxic documents only.
            if inside[stem] >= STEM_WORDS and len(before) >= 2 * MIN_CONTEXTS and odds(len(before), outside[stem]) >= 2 * MIN_ODDS and not any(stem.startswith(x) for x in stems):
                stems[stem] = math.log(odds(len(before), outside[stem]))
    return Lexicon({w: x for w, x in terms.items() if not any(w.startswith(s) for s in stems)}, stems)


class Reader:
    """Finds hits in texts and sums them up by kind; remembers words already read."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.seen: dict[str, tuple[str, int] | None] = {}

    def _read(self, word: str) -> tuple[str, int] | None:
        if word not in self.seen:
            self.seen[word] = self.lexicon.match(word)
        return self.seen[word]

    def _whole(self, token: str) -> tuple[str, int] | None:
        """The nearest entry of a token read with its inner signs or without them; None if it is letters only."""
        core = token.strip(_OUTER)
        if not core or core.isalpha() or not _WORD.search(core):
            return None
        found = [h for h in (self._read(core), self._read(_SIGNS.sub("", core))) if h]
        return min(found, key=lambda h: h[1]) if found else None

    def _disguised(self, lowered: str) -> list[tuple[int, int, tuple[str, int]]]:
        """(start, end, hit) of the tokens that hit as a whole, without overlaps: fewest errors first, then the longest."""
        found = []
        # Most tokens are letters only, which the cheap test passes over before positions are looked for.
        odd = {t for t in set(lowered.split()) if not t.isalpha() and not t.strip(_OUTER).isalpha()}
        if any(self._whole(t) or any(map(self._whole, _PART.findall(t))) for t in odd):
            for m in _TOKEN.finditer(lowered):
                if m.group() in odd:
                    spans = [m.span(), *((m.start() + x.start(), m.start() + x.end()) for x in _PART.finditer(m.group()))]
                    found += [(a, b, h) for a, b in spans if (h := self._whole(lowered[a:b]))]
        for m in _SPELT.finditer(lowered):
            joined = _SIGNS.sub("", m.group())
            if _WORD.search(joined) and (h := self._read(joined)):
                found.append((*m.span(), h))
        kept: list[tuple[int, int, tuple[str, int]]] = []
        # A mark for each character that a kept span holds: spans of one kind are disjoint, so that all tests together read the text a few times.
        held = bytearray(len(lowered)) if found else bytearray()
        for a, b, h in sorted(found, key=lambda x: (x[2][1], x[0] - x[1], x[0])):
            if held.find(1, a, b) < 0:
                held[a:b] = b"\1" * (b - a)
                kept.append((a, b, h))
        return sorted(kept)

    def features(self, text: str) -> np.ndarray:
        """Abusive weight, quoted weight, misspelt weight, density, address, crowding of one whole text."""
        lowered = text.lower()
        words = _WORD.findall(lowered)
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        seen, match = self.seen, self.lexicon.match
        for w in set(words):
            if w not in seen:
                seen[w] = match(w)
        out = np.zeros(6)
        found: list[tuple[str, int] | None] = list(map(seen.__getitem__, words))
        disguised = self._disguised(lowered)
        if not disguised and not any(found):
            return out
        starts = [m.start() for m in _WORD.finditer(lowered)]
        read, at = [(words, found, starts), ([], [], [])], 0
        for a, b, hit in disguised:
            lo, hi = bisect_left(starts, a), bisect_left(starts, b)
            if all(h is None or h[1] > hit[1] for h in found[lo:hi]):
                for old, new, x in zip(*read, (lowered[a:b], hit, a), strict=True):
                    new += [*old[at:lo], x]
                at = hi
        words, found, starts = (new + old[at:] for old, new in zip(*read, strict=True))
        hits = [(i, h) for i, h in enumerate(found) if h]
        spans = quoted_spans(lowered)
        begins = [a for a, _ in spans]
        place = [bisect_left(begins, starts[i]) - 1 for i, _ in hits]
        quoted = [k >= 0 and starts[i] < spans[k][1] for k, (i, _) in zip(place, hits, strict=True)]
        last = -10 * WINDOW
        for (i, (entry, errors)), within in zip(hits, quoted, strict=True):
            near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
            weight = self.lexicon.weight(entry) * (1.0 if not errors else 0.5 / errors)
            if within or REPORTING.intersection(near):
                out[1] += weight
            else:
                out[0] += weight
            out[2] += weight * bool(errors)
            out[4] += weight * bool(ADDRESS.intersection(near))
            out[5] += i - last <= 2 * WINDOW
            last = i
        out[3] = min(len(hits) / max(len(words), 1) * 100, 50)
        return np.array([np.log1p(out[0]), np.log1p(out[1]), np.log1p(out[2]), np.log1p(out[3]), np.log1p(out[4]), np.log1p(out[5])])


class Model:
    """A lexicon and a logistic model over its sums."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.w, self.bias = np.zeros(6), -4.0

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, decay: float = 1e-2) -> None:
        """Newton steps on the regularised logistic loss."""
        a = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            g = a.T @ (p - y) / len(y) + decay * np.r_[w[:-1], 0]
            h = (a.T * (p * (1 - p))) @ a / len(y) + np.diag([*[decay] * (a.shape[1] - 1), 1e-6])
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.w, self.bias = w[:-1], w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.bias, -30, 30)))


def train(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, 0 or 1) rows; without toxic rows nothing is toxic.

    The lexicon comes from one half of the rows and the weights from the other,
    so that a word's chance occurrence does not vouch for itself; the lexicon
    used afterwards comes from both.
    """
    classes = [[r for r in rows if r[1] == k] for k in range(2)]
    some, rest = ([r for c in classes for r in c[k::2]] for k in range(2))
    model = Model(learn_lexicon(some))
    reader = Reader(model.lexicon)
    y = np.array([label for _, label in rest], float)
    if len(set(y)) == 2:
        model.fit(np.stack([reader.features(t) for t, _ in rest]), y)
    model.lexicon = learn_lexicon(rows)
    return model


_READERS: dict[str, Reader] = {}


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, hits: abusive, quoted and misspelt weights of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, m = shared.value
        if name not in _READERS:
            _READERS.clear()
            _READERS[name] = Reader(m.lexicon)
        for b in text_slices(batches, 1):
            rows = [_READERS[name].features(t or "") for t in b.column(1).to_pylist()]
            if rows:
                x = np.stack(rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x)), *(pa.array(np.expm1(x[:, k])) for k in range(3))], ["doc_id", "score", "abusive", "quoted", "misspelt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, abusive double, quoted double, misspelt double")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, abusive, quoted, misspelt for every row of ``docs``.

    Learns from at most ``per_class`` labelled rows of each class outside the
    held-out fold (crc32 of the id as text, mod 5 = 0).  Null and empty texts
    score as a text without hits; so does every text where no label was given.
    Extra columns are ignored; an empty table gives an empty result.
    """
    model = train(labelled_texts(docs, labels, "toxic", fold(F.col("doc_id"), 5) == 0, per_class))
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "abusive", "quoted", "misspelt")
