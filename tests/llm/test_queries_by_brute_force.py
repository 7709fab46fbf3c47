"""Whole results of the queries that SQL cannot express, against plain Python over the same tables."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tellurian.llm import order_minhash, quality, sampling, toxicity
from tellurian.llm.queries import QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet"), {r.doc_id: r.text or "" for r in docs.collect()}


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_sample(docs, labels, label):
    """What the sample must be where all rows fit its bounds: the open rows with one label."""
    of: dict = {}
    for r in labels.select("doc_id", label).collect():
        if r[1] is not None and not held(r.doc_id):
            of.setdefault(r.doc_id, set()).add(int(r[1]))
    return [(docs[i], next(iter(v))) for i, v in sorted(of.items()) if len(v) == 1 and i in docs]


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


class PlainLexicon:
    """A lexicon that compares each word with each term and stem."""

    def __init__(self, lexicon):
        self.lexicon, self.weight = lexicon, lexicon.weight

    def match(self, word):
        for n in range(1, len(word) + 1):
            if word[:n] in self.lexicon.stems:
                return word[:n], 0
        found = []
        for term in self.lexicon.terms:
            most = toxicity.allowed_errors(len(term))
            if abs(len(word) - len(term)) <= most and (d := distance(word, term, most)) <= most:
                found.append((d, term))
        return min(found)[::-1] if found else None


def test_toxicity_query(spark, tables):
    docs, labels, texts = tables
    model = toxicity.train(plain_sample(texts, labels, "toxic"))
    reader = toxicity.Reader(PlainLexicon(model.lexicon))
    got = QUERIES["op1_toxicity"](spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for r in got:
        x = reader.features(texts[r.doc_id])
        score = 1 / (1 + np.exp(-np.clip(x @ model.w + model.bias, -30, 30)))
        assert r.score == pytest.approx(score) and r.predicted == int(score >= 0.5) and r.held_out == held(r.doc_id)
        assert r.abusive == pytest.approx(np.expm1(x[0])) and r.quoted == pytest.approx(np.expm1(x[1]))


def test_quality_query(spark, tables):
    _, labels, texts = tables
    machine = quality.train(plain_sample(texts, labels, "quality"))
    features = quality.Features()
    for r in QUERIES["op2_quality"](spark, SF).collect():
        ids, x = features.of(texts[r.doc_id].encode())
        v = machine.v[ids].astype(float) * x[:, None]
        # All pairs, without the identity.
        gram = v @ v.T
        raw = machine.bias + float(machine.w[ids].astype(float) @ x) + (gram.sum() - np.trace(gram)) / 2
        score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
        assert r.score == pytest.approx(score, abs=1e-4) and r.held_out == held(r.doc_id)
        assert r.predicted == int(r.score >= 0.3)


def test_ids_with_two_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (4, 0), (50, 1), (None, 1), (5, None), (6, 7)], "doc_id long, toxic int").withColumns({"label": F.lit("x"), "text": F.lit("y"), "other": F.lit(0)})
    rows = sampling.labelled_texts(docs, labels, "toxic", sampling.fold(F.col("doc_id"), 5) == 0, 100)
    want = [(f"text {i}", i % 2) for i in range(30) if not held(i) and i not in (3, 6)]
    assert sorted(rows) == sorted(want)
    few = sampling.labelled_texts(docs, labels, "toxic", sampling.fold(F.col("doc_id"), 5) == 0, 4)
    assert Counter(y for _, y in few) == {0: 4, 1: 4}
    assert sum(len(t) for t, _ in sampling.labelled_texts(docs, labels, "toxic", sampling.fold(F.col("doc_id"), 5) == 0, 100, most_bytes=30)) <= 30


def test_every_class_has_its_sample(spark):
    d = spark.createDataFrame([(i, "common" if i % 50 else "rare") for i in range(3000)], "doc_id long, lang string")
    got = sampling.smallest_of_each(d, 20, "lang")
    assert {r["lang"]: r["n"] for r in got.groupBy("lang").agg(F.count("*").alias("n")).collect()} == {"common": 20, "rare": 20}
    everything = sampling.smallest_of_each(d, 5000, "lang")
    assert everything.count() == 3000


def chained(*values, seed=42):
    """Spark's xxhash64 of several columns: each one's hash seeds the next; nulls are passed over."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q" if v[1] == 8 else "<i", v[0]), seed=seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text):
    """The definition, k-mer by k-mer."""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return ""
    high, low = order_minhash.HIGH, order_minhash.LOW
    hashes = [chained(*[words[i + j] if i + j < len(words) else None for j in range(order_minhash.K)]) & high for i in range(len(words))]
    seen: Counter = Counter()
    numbered = []
    for i, h in enumerate(hashes):
        n = seen[h]
        seen[h] += 1
        numbered.append(((chained((h, 8), (n, 4)) & high if n else h), i & low))
    bins: dict[int, list] = {}
    for h, i in sorted(numbered):
        bins.setdefault(h >> (63 - (order_minhash.BINS.bit_length() - 1)), []).append((i, h))
    out = []
    for b in range(order_minhash.BINS):
        picked = sorted(bins.get(b, [])[: order_minhash.ELL], key=lambda p: p[0])
        out.append(f"{chained(*[(h, 8) for _, h in picked]):016x}"[-8:] if picked else "-")
    return " ".join(out)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    pairs = [(x, y) for x, y in zip(a.split(" "), b.split(" "), strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs)


def test_fingerprint_query(spark, tables):
    texts = tables[2]
    order = sorted(texts, reverse=True)
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    for r in QUERIES["op5_order_minhash"](spark, SF).collect():
        nxt = order[(order.index(r.doc_id) + 1) % len(order)]
        text, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        edited = plain_fingerprint(text[: len(text) - half] + texts[nxt][:half])
        assert r.fingerprint == prints[r.doc_id] and r.edited_fingerprint == edited
        assert r.near_edited == pytest.approx(plain_likeness(prints[r.doc_id], edited)) and r.near_next == pytest.approx(plain_likeness(prints[r.doc_id], prints[nxt]))


@pytest.mark.parametrize("text", ["", " \n", "a", "a b", "a b a b a b a b", "x " * 200, "one two three four\tfive\nsix seven eight " * 9])
def test_fingerprint_definition(spark, text):
    got = order_minhash.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.fingerprint == plain_fingerprint(text)


def test_likeness_follows_edits(spark):
    """Fewer kept words, less likeness: over rising shares of replaced words."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for k, share in enumerate((0.0, 0.05, 0.1, 0.2, 0.4, 0.8)):
        changed = [w if rng.random() >= share else f"n{i}" for i, w in enumerate(words)]
        rows.append((k, " ".join(changed)))
    fp = [r.fingerprint for r in order_minhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    likeness = [plain_likeness(fp[0], f) for f in fp]
    assert likeness == sorted(likeness, reverse=True) and likeness[0] == 1 and likeness[-1] < 0.1
