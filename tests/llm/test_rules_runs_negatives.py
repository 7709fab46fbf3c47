"""Quality rules, periodic runs and hard negatives against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellurian.llm import hard_negatives as hn
from tellurian.llm import periodic_runs as pr
from tellurian.llm import quality_rules as qr
from tellurian.llm.queries import QUERIES
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words string, `__k0` int, kept int"


def plain_measures(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    held = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    stop = {*qr.STOP_WORDS, *(s[0].upper() + s[1:] for s in qr.STOP_WORDS)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_capitals": len(re.findall("[A-Z]", text or "")),
        "n_stop_words": sum(x.strip(".,;:!?\"'()") in stop for x in w), "n_lettered": sum(any(map(str.isalpha, x)) for x in w),
        "n_stuttered": sum(a == b for a, b in zip(w, w[1:])), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullets": sum(x.lstrip(" \t\n\x0b\x0c\r")[0] in "-*•" for x in lines), "n_cut_lines": sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines), "n_repeat_words": len(held),
    }


def plain_broken(m, rules=qr.RULES):
    out = []
    for r in rules:
        a, b = 1000 * m[r.numerator], m[r.denominator]
        if (r.least is not None and a < r.least * b) or (r.most is not None and a > r.most * b):
            out.append(r.name)
    return out


TEXTS = [
    None, "", "   \n\t ", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "- a line\n- a line\n\n * b...\nthe end…", "##** $$ <tag> | 100 %",
    "la la la the of and to\r\nla la\r\n" * 9, " ".join(f"w{i % 9}" for i in range(300)), " ".join(f"w{i}" for i in range(30_000)) + " the end " + " ".join(f"w{i}" for i in range(8)),
    "THE VERY LOUD TEXT OF " * 10, "été über niño 北京 " * 30, "\x1c\x1d\x85\xa0 no blanks here  at all",
]


def test_quality_rules_of_odd_texts(spark):
    docs = spark.createDataFrame([(None if i == 3 else i, t, "x", 1, 2) for i, t in enumerate(TEXTS + TEXTS[4:6])], DOCS)
    got = qr.quality_rules(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    of = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        want, r = plain_measures(t), of[None if i == 3 else i]
        assert {k: r[k] for k in want} == want, i
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert (r.base_failed, list(r.broken), r.kept) == (failed, plain_broken(want), not failed and not plain_broken(want))


def test_quality_rules_where_hashes_share_their_leading_bits(spark, monkeypatch):
    """A window found on few bits must be told apart by the whole hash."""
    real = F.xxhash64
    # All hashes share their upper half, so that packing tells nothing.
    monkeypatch.setattr(qr.F, "xxhash64", lambda *c: real(*c).bitwiseAND(F.lit(7)))
    docs = spark.createDataFrame([(0, " ".join(f"w{i % 50}" for i in range(200)))], "doc_id long, text string")
    assert qr.quality_rules(docs).first().n_repeat_words == 200


def test_quality_rules_take_any_table(spark):
    docs = spark.createDataFrame([(0, "one two three four five")], "doc_id long, text string")
    rules = (qr.Rule("few", "n_words", "n_lines", None, 4000), qr.Rule("many", "n_words", "n_lines", 4000))
    assert list(qr.quality_rules(docs, rules).first().broken) == ["few"]
    assert list(qr.quality_rules(docs, ()).first().broken) == []
    assert qr.quality_rules(docs.limit(0)).count() == 0


def plain_runs(w):
    out: dict = {}
    for q in range(1, len(w) // 4 + 1):
        p = 0
        while p < len(w) - q:
            if w[p] != w[p + q]:
                p += 1
                continue
            s = p
            while p < len(w) - q and w[p] == w[p + q]:
                p += 1
            if p - s + q >= max(6, 4 * q):
                out.setdefault((s, p - s + q), q)
    return sorted((s, q, n) for (s, n), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50).flatmap(lambda t: st.integers(1, 5).map(lambda k: t * k)), max_size=6))
def test_runs_of_texts_laid_end_to_end(texts):
    words, text = pr.numbered(texts)
    runs, end = pr.find_runs(words, text), 0
    for t in texts:
        x = runs.between(end, end + len(t))
        end += len(t)
        assert list(zip(x.start.tolist(), x.period.tolist(), x.length.tolist())) == plain_runs(t)


def test_one_word_a_million_times_is_one_run():
    words, text = pr.numbered([[1] * 300_000, [1, 2] * 100_000, [1] * 7])
    x = pr.find_runs(words, text)
    assert list(zip(x.start.tolist(), x.length.tolist(), x.period.tolist())) == [(0, 300_000, 1), (300_000, 200_000, 2), (500_000, 7, 1)]


def plain_probe(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def test_runs_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    # Plain Python is quadratic: the few longest texts are left to the tests above.
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        if len(t or "") < 20_000:
            r = got[i]
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == plain_probe(i, t), i


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 9), (4, "a " * 9), (None, "b c " * 8 + "tail"), (5, "北 京 " * 5)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    got = sorted((tuple(r[:5]) + (r.collapsed, len(r.runs)) for r in pr.periodic_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, None, None, None, "", 0), (2, 0, None, None, None, "", 0), (3, 0, None, None, None, "", 0), (4, 1, 0, 9, 1, "a", 1), (4, 1, 0, 9, 1, "a", 1), (None, 1, 0, 16, 2, "b c tail", 1), (5, 1, 0, 10, 2, "北 京", 1)], key=str)
    assert pr.run_probe(docs).where("doc_id IS NULL").first().n_runs == 1
    assert pr.periodic_runs(docs.limit(0)).count() == 0


def plain_negatives(rows, positives=5, negatives=10, band=(30, 90)):
    kept: dict = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, r), r)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        ranked = sorted((-dot(v, w), i, k) for i, (k, w) in kept.items() if i != a)
        for s, p, _ in [x for x in ranked if x[2] == label][:positives]:
            fit = [x for x in ranked if x[2] != label and band[0] * -s <= 100 * -x[0] <= band[1] * -s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i, _) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, score int, slot string"


def mined(spark, rows, **how):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)
    return sorted(map(tuple, hn.hard_negatives(d, lambda i: i % 100 == 0, **how).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_negatives_with_ties_and_odd_rows(spark, seed):
    rng = np.random.default_rng(seed)
    # Few values a component, so that scores tie; positive on the whole, so that bands hold rows.
    rows = [(i, [float(x) for x in rng.integers(-1, 5, 6) / (1 if seed else 256)], int(i % 3)) for i in range(430)]
    rows += [(500, None, 1), (600, [1.0] * 6, None), (700, [1.0, None, 1.0], 1), (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1000, [], 1), (1001, [2.0], 0)]
    rows += [rows[7], (9, rows[10][1], 2), (100, rows[11][1], 0)]
    assert mined(spark, rows) == plain_negatives(rows) != []


def test_negatives_in_many_cells_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0.05, 0.1, 16)], int(rng.integers(0, 4))) for i in range(1500)]
    want = plain_negatives(rows)
    for name, n in (("ANCHOR_ROWS", 4), ("BLOCK_ROWS", 200), ("TILE_ROWS", 64), ("TILE_ANCHORS", 2)):
        monkeypatch.setattr(hn, name, n)
    assert mined(spark, rows) == want
    monkeypatch.setattr(hn, "SPARSE", 2.0)
    assert mined(spark, rows) == want


def test_negatives_of_huge_components_and_of_few_rows(spark):
    rows = [(0, [1e9, 2e9], 0), (1, [1e9, 1e9], 0), (2, [1e9, 5e8], 1), (3, [5e8, 5e8], 1), (4, [-1e9, 0.0], 1)]
    assert mined(spark, rows) == plain_negatives(rows, band=(30, 90)) or all(r[4] == (1 << 63) - 1 for r in mined(spark, rows))
    small = [(0, [3e4, 2e4], 0), (1, [3e4, 2e4], 0), (2, [2e4, 1e4], 1), (3, [1e4, 1e4], 1)]
    assert mined(spark, small) == plain_negatives(small) != []
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(0, [1e38, 1.0], 1), (1, [1e38], 1), (2, [3.0], 2)]) == []
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS), lambda i: i % 100 == 0).count() == 0
