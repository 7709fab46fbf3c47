from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellurian.llm import byte_bpe, language_id, order_minhash, quality, toxicity
from tellurian.llm.queries import QUERIES
from tests.conftest import SF

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.read_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = byte_bpe.Codec(RANKS, PATTERN)
DOCS = "doc_id long, text string"


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_encoding_equals_the_library(texts):
    got = CODEC.encode(texts)
    assert got == [packed(ENCODING.encode_ordinary(t)) for t in texts]
    assert CODEC.decode(got) == [t.encode() for t in texts]


def test_long_pieces_and_small_caches(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "GATHER_BYTES", 50)
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 8)
    monkeypatch.setattr(byte_bpe, "SEGMENT", 7)
    texts = ["a" * 3000, "!" * 600, " " * 900 + "x", "abab" * 300, "<|endoftext|>", "é中\U0001f600" * 200, "The quick brown fox " * 30]
    got = CODEC.encode(texts)
    assert got == [packed(ENCODING.encode_ordinary(t)) for t in texts]
    assert CODEC.decode(got) == [t.encode() for t in texts]


def test_bpe_tables(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n"), (None, "x" * 9000)], DOCS).withColumns({"ids": F.lit("i"), "bytes": F.lit(0)})
    coded = byte_bpe.bpe_encode(d, PATH, PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in coded.collect()} == {(1, ()), (2, ()), (3, tuple(ENCODING.encode_ordinary("Hello  world\n"))), (None, tuple(ENCODING.encode_ordinary("x" * 9000)))}
    assert {(r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.bpe_decode(coded, PATH, PATTERN).collect()} == {(1, ""), (2, ""), (3, "Hello  world\n"), (None, "x" * 9000)}
    assert byte_bpe.bpe_round_trip(spark.createDataFrame([], DOCS), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("letters,length", [("eatnor", 250), ("абвгдеёжз", 125), ("acgt", 250)])
def test_many_long_words_fit_the_memory_limit(letters, length):
    rng = np.random.default_rng(4)
    text = " ".join("".join(rng.choice(list(letters), length)) for _ in range(450))
    got = byte_bpe.Codec(RANKS, PATTERN).encode([text])
    assert got == [packed(ENCODING.encode_ordinary(text))]


def test_bpe_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ENCODING.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# --- order minhash ---


def test_fingerprints_follow_order_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(300))
    words = base.split()
    swapped = " ".join(words[150:] + words[:150])
    data = [(1, base), (2, base), (3, swapped), (4, base + " tail"), (5, " ".join(["one two three"] * 200)), (6, " ".join(["one two three"] * 100)), (7, None), (8, " \n"), (9, "one"), (10, "one two")]
    fp = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(spark.createDataFrame(data, DOCS)).collect()}
    pairs = spark.createDataFrame([(a, b, fp[a], fp[b]) for a in fp for b in fp], "a long, b long, x string, y string")
    near = {(r.a, r.b): r.v for r in pairs.select("a", "b", order_minhash.likeness(F.col("x"), F.col("y")).alias("v")).collect()}
    assert near[1, 2] == 1 and near[1, 4] > 0.9 and near[1, 3] < 0.9 and near[1, 3] < near[1, 4]
    assert near[5, 6] < 1 and near[7, 8] == 1 and near[7, 9] == 0 and near[9, 10] == 0
    assert fp[7] == fp[8] == ""


@pytest.mark.parametrize("data", [
    [(1, "a b c d"), (5, None), (3, "x é\U0001f600 y z"), (7, "")], [(1, "alone in the table")], [(2, "q w e r"), (2, "q w e r"), (2, "t y u"), (None, "n u l l"), (9, "long text " * 30_000)],
])
def test_edit_probe_equals_brute_force(spark, data):
    got = order_minhash.edit_probe(spark.createDataFrame(data, DOCS).withColumns({"rid": F.lit(1), "tail": F.lit("t"), "half": F.lit(0)})).collect()
    assert len(got) == len(data)
    tie = {t: h for t, h in spark.createDataFrame(list({(t or "",) for _, t in data}), "t string").select("t", F.xxhash64("t")).collect()}
    order = sorted({(i, t or "") for i, t in data}, key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1]]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        nxt, half = order[(k + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        times = sum((a, b or "") == (i, t) for a, b in data)
        want += [(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] * times
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_edit_probe_empty(spark):
    assert order_minhash.edit_probe(spark.createDataFrame([], DOCS)).count() == 0


# --- language identification ---


def test_gradients_match_finite_differences():
    net = language_id.Gru(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 105, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = net.gradients(x, y)
    for name in ("out", "bias", "xf", "ub", "cf", "cb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][at] += 1e-4
        up, _ = net.gradients(x, y)
        net.p[name][at] -= 2e-4
        down, _ = net.gradients(x, y)
        net.p[name][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[name][at], rel=5e-2, abs=1e-5)


def test_chunks_carry_their_state(monkeypatch):
    """Reading in chunks equals reading whole texts plainly, as long as a text is one chunk, and nearly so beyond."""
    rng = np.random.default_rng(1)
    net = language_id.Gru(["a", "b", "c"], hidden=5)
    texts = [bytes(rng.choice(list(b"abcXYZ .\xc3\xa9"), n)) for n in (1, 7, 40, 40, 3, 90)] + [b""]

    def plain(text):
        x = language_id._bytes_of(text)[None]
        prob = net.probabilities(x)[:, 0]
        counted = language_id._IS_LETTER[x[0]]
        return prob[counted].mean(axis=0) if counted.any() else np.zeros(3)

    want = np.stack([plain(t) if t else np.zeros(3) for t in texts])
    assert net.pool(texts) == pytest.approx(want, abs=1e-5)
    assert net.pool(texts[::-1])[::-1] == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(language_id, "CHUNK", 16)
    monkeypatch.setattr(language_id, "CONTEXT", 16)
    monkeypatch.setattr(language_id, "ROWS", 4)
    assert net.pool(texts) == pytest.approx(want, abs=2e-3)


def test_word_order_and_digits_reach_the_network(spark):
    """What stands across a blank or among digits changes the states: the text is not a bag of words."""
    net = language_id.Gru(["a", "b"], hidden=6)
    one, two, three = net.pool([b"ab cd ef", b"ef ab cd", b"ab9cd!ef"])
    assert np.abs(one - two).max() > 1e-4 and np.abs(one - three).max() > 1e-4


def test_two_models_in_one_session(spark):
    d = spark.createDataFrame([(i, "the cat and the dog sat") for i in range(8)], DOCS).repartition(4)
    swapped = [language_id.train([("the cat and the dog " * 9, x), ("le chat et la maison " * 9, y)] * 20, steps=40, batch=32) for x, y in (("en", "fr"), ("fr", "en"))]
    for net, want in zip([*swapped, *swapped], ["en", "fr"] * 2, strict=True):
        assert {r.lang_pred for r in language_id.identify(d, net).collect()} == {want}
    for term, hit in (("cat", True), ("zebra", False), ("dog", True)):
        model = toxicity.Model(toxicity.Lexicon({term: 5.0}, {}))
        assert all((r.abusive > 0) == hit for r in toxicity.score_texts(d, model).collect())


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    # Brute force: the same network over each whole text on its own.
    net = language_id.fit_on(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in got:
        text = docs[r.doc_id].text or ""
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        prob = net.pool([text.encode()])[0]
        assert r.lang_pred == net.languages[prob.argmax()] and r.score == pytest.approx(prob.max(), abs=1e-4)
    held = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert np.mean(held) > 0.9


def test_language_awkward(spark):
    rows = [("the cat and the dog", "en"), ("le chat et la maison", "fr")] * 20
    net = language_id.train([(t + " ", k) for t, k in rows], steps=60, batch=64)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the dog"), (4, "the dog"), (None, "日本"), (6, "the cat " * 40_000)], DOCS).withColumns({"score": F.lit("s"), "lang_pred": F.lit(1)})
    got = language_id.identify(d, net).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id in (4, 6)} == {"en"}
    assert all(r.lang_pred == "und" for r in language_id.identify(d, None).collect())
    assert language_id.identify(spark.createDataFrame([], DOCS), net).count() == 0
    assert language_id.train([]) is None


# --- quality and toxicity ---


def test_sum_of_squares_identity():
    fm = quality.FactorisationMachine(20, rank=3, seed=1)
    fm.w[:] = np.random.default_rng(2).normal(0, 1, 20)
    ids, x = np.array([1, 4, 9, 13]), np.array([0.5, 1.0, 2.0, 0.25])
    pairs = sum(float(fm.v[ids[i]] @ fm.v[ids[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    raw, _ = fm.raw(ids, x, np.zeros(4, int), 1)
    assert raw[0] == pytest.approx(float(fm.w[ids] @ x) + pairs, rel=1e-4)


def test_quality_learns(spark):
    rng = np.random.default_rng(0)
    good = [(" ".join(rng.choice(["river", "stone", "house", "green", "walks"], 40)) + ".", 1) for _ in range(80)]
    bad = [(" ".join(rng.choice(["BUY", "NOW", "CHEAP"], 40)) + "!!! ###", 0) for _ in range(80)]
    m = quality.train(good[:60] + bad[:60])
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(good[60:] + bad[60:])], DOCS)
    s = [r.score for r in quality.score_texts(d, m).orderBy("doc_id").collect()]
    assert min(s[:20]) > 0.5 > max(s[20:])


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_classifiers_awkward(spark, operator):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 60_000), (3, "a"), (None, "x")], DOCS).withColumns({"score": F.lit("s"), "label": F.lit(1), "quality": F.lit(0)})
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (2, 0, 1), (2, 0, 1), (None, 1, 1), (3, None, None)]):
        got = operator(d, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert operator(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abco", min_size=1, max_size=11))
def test_automaton_equals_edit_distance(word):
    terms = ["abc", "abcoa", "cocoa", "aabbccoo", "abcabcabca"]
    want = min(((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.allowed_errors(len(t))), default=None)
    got = LEXICON.match(word)
    assert (None if got is None else (got[1], got[0])) == want


LEXICON = toxicity.Lexicon({t: 1.0 for t in ["abc", "abcoa", "cocoa", "aabbccoo", "abcabcabca"]}, {})


def test_quotation_is_told_from_abuse():
    reader = toxicity.Reader(toxicity.Lexicon({"scoundrel": 5.0}, {"vill": 4.0}))
    abuse, quoted, reported, misspelt, stem, clean = (reader.features(t) for t in ("you scoundrel there", 'the play has "a scoundrel" in it', "she called him a scoundrel", "you scoundrl", "what villainy", "fine day"))
    assert abuse[0] > 0 and abuse[1] == 0 and quoted[0] == 0 and quoted[1] > 0 and reported[1] > 0
    assert 0 < misspelt[0] < abuse[0] and misspelt[2] > 0 and stem[0] > 0 and not clean.any()


def test_signs_inside_words_do_not_hide_them():
    reader = toxicity.Reader(toxicity.Lexicon({"idiot": 5.0, "stupid": 5.0, "moron": 5.0, "disgusting": 5.0}, {}))
    for text in ("id1ot", "stup1d", "mor0n", "disgust1ng", "st*pid", "s.t.u.p.i.d", "(id1ot!)", "what a st*pid, idea", "so s t u p i d it is", "s_t_u_p_i_d", "un l'id1ot", "stu-pid"):
        assert reader.features(text)[0] > 0, text
    quoted = reader.features('they said "id1ot" once')
    assert quoted[0] == 0 and quoted[1] > 0
    assert np.array_equal(reader.features("you stupid-looking idiot."), reader.features("you stupid looking idiot"))
    for text in ("room 101, 2.5 km", "a b c d e", "1 2 3 4 5", "mail x.y@example.com", "well-known l'homme don't", ""):
        assert not reader.features(text).any(), text


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op2_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] > least


def test_open_quotation_marks_quote_nothing():
    reader = toxicity.Reader(toxicity.Lexicon({"scoundrel": 5.0}, {}))
    for text in ('a 6" pipe ' + "stone " * 60 + "you scoundrel there", 'he began "so ' + "stone " * 200 + "you scoundrel there", '" scoundrel', 'scoundrel "', '"a" scoundrel "b"', 'a 6" and 7" scoundrel'):
        f = reader.features(text)
        assert f[0] > 0 and f[1] == 0, text
    for text in ('"scoundrel"', "« scoundrel »", "„ein scoundrel“", "“a scoundrel”", "»scoundrel«", 'a 6" pipe, "the scoundrel", 7"', '("scoundrel")', '"no!" and "scoundrel."'):
        f = reader.features(text)
        assert f[0] == 0 and f[1] > 0, text


def test_many_disguised_hits_in_one_text():
    """Hits are told apart in one pass, as by comparing every pair of spans."""
    import time

    lexicon = toxicity.Lexicon({"idiot": 2.0, "moron": 1.5, "clown": 1.0}, {"disgust": 2.0})
    reader = toxicity.Reader(lexicon)
    began = time.time()
    many = reader.features("id1ot mor0n's c-l-o-w-n " * 70_000)
    assert time.time() - began < 20
    few = reader.features("id1ot mor0n's c-l-o-w-n " * 700)
    assert np.expm1(many[0]) == pytest.approx(100 * np.expm1(few[0]), rel=1e-6) and many[3] == pytest.approx(few[3])
    spans = reader._disguised("id1ot st-mor0n-x c l o w n")
    assert all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:], strict=False)) and len(spans) == 3
