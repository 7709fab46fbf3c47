from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tellurian.llm import mixing, simhash
from tellurian.llm.byte_bpe import read_ranks
from tests.conftest import SF


def test_stages_against_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = source, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), source.schema)
        assert docs.columns == source.columns
        kept[name] = docs.collect()
    before = {r.doc_id: r for r in kept["language_id"]}
    assert len(before) >= 0.98 * source.count()
    best: dict = {}
    for r in before.values():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(best.values())
    prints = [(r.doc_id, simhash.text_fingerprint(r.text.encode())) for r in sorted(kept["exact_dedup"])]
    group = {i: i for i, _ in prints}
    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if bin(x ^ y).count("1") <= 3:
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert sorted(r.doc_id for r in kept["near_dedup"]) == sorted({v for v in group.values()})
    plan = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix(spark.createDataFrame(kept["near_dedup"], source.schema)).collect()}
    assert sorted(r.doc_id for r in kept["mix_sources"]) == sorted(i for i, n in plan.items() for _ in range(n))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in kept["mix_sources"]}
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(tokens) == len(kept["mix_sources"])
    for r in tokens:
        ids = np.array(enc.encode_ordinary(texts[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_run_ends_in_tokens(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_dedup_stages_keep_one_row_of_each_group(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    words = [f"{w} {i} " * 30 for i, w in enumerate(("river", "stone", "house", "green", "walks", "paper"))]
    row = lambda i, text, lang="en": tuple({"doc_id": i, "text": text, "lang": lang, "source": "s", "n_chars": len(text or "")}[c] for c in schema.names)
    given = [row(1, words[0])] * 3 + [row(2, words[1]), row(2, words[2]), row(None, words[3]), row(None, words[4]), row(None, words[0]), row(None, words[5], "fr"), row(None, words[5])]
    docs = spark.createDataFrame(given, schema)
    want = sorted([(1, words[0]), (2, words[1]), (2, words[2]), (None, words[3]), (None, words[4]), (None, words[5])], key=str)
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want
    again = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_copies(spark, docs, SF), SF)
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=str) == want


def test_stages_take_any_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns with the stages' inner names."""
    text = "the river runs past the old stone house and on to the town "
    given = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, text + "again", "en", None, 1), (None, None, None, None, None), (4, "le fleuve passe devant la vieille maison et la ville " * 4000, "fr", "t", 9), (5, " \n\t", "fr", "t", 3), (6, "12 34 !!", "fr", "t", 8)]
    given += [(100 + i, f"{text}{i} times over and {i} again", "en", "s", 1) for i in range(12)] + [(200 + i, f"le chat {i} dort dans la maison de {i} voisins", "fr", "t", 1) for i in range(12)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("score", "lang_pred", "key", "fp", "cls", "best", "size", "row", "a.b", "component_id", "keep_id")
    for n in clash:
        docs = docs.withColumn(n, F.lit(n))
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        after[name] = Counter((r.doc_id, r.text) for r in got.collect())
        assert set(after[name]) <= {(i, t) for i, t, *_ in given}
    assert not any(t is None or not any(map(str.isalpha, t)) for _, t in after["language_id"])
    assert after["language_id"][1, text] == 2 and (4, given[6][1]) in after["language_id"]
    distinct = {t or "" for _, t, *_ in given}
    assert Counter(t or "" for _, t in after["exact_dedup"].elements()) == Counter(distinct)
    assert after["exact_dedup"][3, ""] == 1 and after["exact_dedup"][1, text] == 1
    blank = [t for _, t in after["near_dedup"].elements() if not (t or "").split()]
    assert len(blank) == 1 and all(n == 1 for n in after["near_dedup"].values())
    assert not any(t is None or not t.split() for _, t in after["mix_sources"])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.count() == len(given) and tokens.where("doc_id IN (2, 3)").agg(F.sum("n_tokens")).first()[0] == 0


def test_run_leaves_only_its_last_table(spark):
    from tellurian.llm import store

    since = store.mark(spark)
    corpus_pipeline.run(spark, SF)
    assert store.mark(spark) == since + 1


FOREIGN = {
    "russian": "Привет, это обычный русский текст о погоде и природе нашей большой страны".split(),
    "arabic": "هذا نص عربي عادي عن الطقس والطبيعة في بلادنا الجميلة".split(),
    "japanese": ["これは", "日本語の", "普通の", "文章です", "天気が", "いいです"],
    "mash": ["qzx", "vbn", "wrt", "hjk", "zxcv", "qwfp", "plkj", "mnbv", "xcvb", "dfgh", "ghjk"],
    "code": ["for (int i = 0; i < n; i++) {", "if (ptr == NULL) return -1;", "struct node *next;", 'printf("%d", x);', "memcpy(dst, src, len);", "x = y->z[k] << 3;", "#include <stdio.h>", "while (fgets(buf, sizeof buf, fp))"],
}


def test_language_stage_turns_strangers_away(spark):
    """Texts of no learned language and no language at all go, held-out documents of any length stay."""
    import base64
    import random

    source = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rng = random.Random(4)
    strange = [" ".join(rng.choice(words) for _ in range(n)) for words in FOREIGN.values() for n in (3, 6, 12, 50) for _ in range(10)]
    strange += [base64.b64encode(rng.randbytes(n)).decode() for n in (20, 60, 400) for _ in range(10)]
    fields = source.schema
    extra = spark.createDataFrame([tuple({"doc_id": 10_000_000 + i, "text": t, "lang": None}.get(f.name, None) for f in fields) for i, t in enumerate(strange)], fields)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, source.unionByName(extra), SF).select("doc_id").collect()}
    gone = sum(10_000_000 + i not in kept for i in range(len(strange)))
    assert gone >= 0.95 * len(strange)
    lettered = [r.doc_id for r in source.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sum(i in kept for i in lettered) >= 0.995 * len(lettered)


def test_statistics_equal_a_loop_over_bytes():
    from tellurian.llm.language_id import Statistics

    rows = [("the ring of things, the other.", "en"), ("les choses, été", "fr"), ("a thing or other ring", "en"), ("une chose été", "fr")] * 10
    s = Statistics(rows)
    texts = ["the thing", "", "12 34", "été the", "привет", "ZEBRA x1y"]
    for text, got in zip(texts, s.score([t.encode() for t in texts]), strict=True):
        total, n = 0.0, 0
        lowered = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        for word in "".join(chr(c) if c >= 128 or 97 <= c <= 122 else " " for c in lowered).split(" "):
            kinds = [0, 0, *(int(s.kind[ord(c)]) for c in word)]
            if word:
                total += max(sum(float(t[(a * s.kinds + b) * s.kinds + c]) for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False)) for t in s.tables)
                n += len(word)
        assert np.isclose(got, total / n) if n else got == -np.inf
    held = sorted(x for x in s.score([t.encode() for t, _ in rows[::5]]))
    assert s.bound == np.quantile(held, 0.002) - 1.5
    # The chances of what may follow add up to one, with the other letter bytes shared out.
    t = np.exp(s.tables[0].reshape(s.kinds, s.kinds, s.kinds))
    t[..., 1] *= 154 - (s.kinds - 2)
    assert np.allclose(t.sum(axis=-1), 1, atol=1e-3)
    assert Statistics([]).bound == -np.inf and Statistics([("a", "en")]).score([b"b", b"1"]).tolist() == [0.0, -np.inf]
