from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tellurian.llm import simhash
from tellurian.llm.exact_dedup import build_directory, exact_dedup, lookup, write_index
from tellurian.llm.queries import SQL, op10_exact_dedup
from tests.conftest import SF, duck_rows, rows

DOCS = "doc_id long, text string"


def awkward(spark):
    """Nulls, blanks, ties, repeated rows, a very long text and columns whose names clash with our own."""
    data = [(1, "a b c"), (2, None), (3, ""), (4, "a b c"), (4, "a b c"), (None, "a b c"), (None, None), (9, "long " * 60_000), (8, "long " * 60_000), (5, "é\U0001f600")]
    return spark.createDataFrame(data, DOCS).withColumns({"key": F.lit("x"), "cls": F.lit(1), "fp": F.lit(2), "bucket": F.lit(3), "best": F.lit(None).cast("int")})


def brute_exact(data):
    groups: dict = {}
    for doc_id, text in data:
        groups.setdefault(text or "", []).append(doc_id)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 64}, {"key_of": lambda b: (len(b) % 3) << 61}, {"key_of": lambda b: 0}])
def test_exact_groups(spark, options):
    d = awkward(spark)
    want = brute_exact([(r.doc_id, r.text) for r in d.collect()])
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    got = exact_dedup(d, **options).collect()
    assert len(got) == d.count()
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in got)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(by_sha)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_windows(spark, monkeypatch):
    from tellurian.llm import exact_dedup as module

    texts = [str(i % 7) for i in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    got = exact_dedup(d).where("kept")
    assert {r.doc_id for r in got.collect()} == set(range(193, 200))
    scan = module._scanner(module.sha_key)
    assert callable(scan)


def test_exact_empty(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_query(spark, duck):
    assert rows(op10_exact_dedup(spark, SF)) == duck_rows(duck, SQL["op10_exact_dedup"])


def test_directory_doubles_and_splits():
    cells = {0: 10, 1: 10, 2: 1, 3: 1, 12: 5}
    depth, slots = build_directory(cells, 10, 4)
    assert depth == 4 and slots[0] != slots[1] and slots[8] == slots[15]
    assert slots == sorted(slots)
    assert build_directory({}, 10, 4) == (0, [0])
    assert build_directory({5: 100}, 10, 4)[0] == 4  # a cell that cannot be split stays whole


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ONE two", "ÉA b C d", "x y z q", "a b c " * 500])
def test_fingerprint(text):
    assert simhash.text_fingerprint(None if text is None else text.encode()) == brute_print(text)


def brute_components(fps):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("shard_points", [4, 40, 10_000])
def test_links_are_exact(spark, shard_points):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, (1 << 64) - 1]
    for _ in range(250):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.link_edges(points, shard_points=shard_points)).collect()}
    want: dict = {}
    for x, top in zip(signed, brute_components(fps), strict=True):
        want.setdefault(top, set()).add(x)
    got: dict = {}
    for x in signed:
        got.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_a_dense_ball_of_fingerprints(spark):
    fps = [a | b << 7 | c << 40 for a in range(16) for b in range(16) for c in range(8)]
    roots = simhash.components(simhash.link_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), shard_points=64))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps) - 1


def test_near_duplicates_awkward(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_dedup(awkward(spark)).collect()}
    zero = "0" * 16
    assert got[(2, zero)] == got[(3, zero)] == got[(None, zero)] == 2
    assert got[(8, f"{brute_print('long ' * 60_000):016x}")] == 8
    assert simhash.simhash_dedup(awkward(spark)).count() == 10
    assert simhash.simhash_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_top_tree_reaches_all_neighbours():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**32, 4000, dtype=np.uint32)
    tree = simhash.TopTree(points[:500], 4)
    query = points ^ (np.uint32(1) << rng.integers(0, 32, 4000).astype(np.uint32))
    ((row, shard, home),) = tree.route(points, 0)
    at_home = dict(zip(row[home].tolist(), shard[home].tolist(), strict=True))
    assert len(at_home) == 4000
    ((row, shard, _),) = tree.route(query, 1)
    reached = set(zip(row.tolist(), shard.tolist(), strict=True))
    assert all((i, s) in reached for i, s in at_home.items())


def test_a_written_index_answers_from_one_bucket(spark, tmp_path):
    d = awkward(spark)
    for name, size in (("small", 64), ("whole", 1 << 20)):
        path = f"file://{tmp_path}/{name}"
        write_index(d, path, bucket_bytes=size)
        want = brute_exact([(r.doc_id, r.text) for r in d.collect()])
        for text, (keep, n) in want.items():
            assert [tuple(r) for r in lookup(spark, path, text or None).collect()] == [(keep, n)]
        assert lookup(spark, path, "not there").count() == 0


def test_points_that_share_a_half(spark):
    """10,000 fingerprints with one upper half: split on the lower one, exactly."""
    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 32, 9000, dtype=np.uint64))
    near = low[:500] ^ (np.uint64(1) << rng.integers(0, 32, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 500, dtype=np.uint64))
    fps = np.unique(np.concatenate([low, near])) | np.uint64(0xABCD1234 << 32)
    half, other = simhash._halves(fps)
    forest = simhash.Forest(len(fps))
    everything = np.arange(len(fps))
    simhash.search(everything, everything, fps, half, 1, 3, forest, other)
    want = simhash.Forest(len(fps))
    for at in range(0, len(fps), 500):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps[None, :]) <= 3)
        want.union(i + at, j)
    assert np.array_equal(forest.find(everything), want.find(everything))


def test_deep_trees_need_no_larger_sample():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2**32, 3000, dtype=np.uint32)
    tree = simhash.TopTree(points[:64], 9)
    ((row, shard, home),) = tree.route(points, 0)
    assert home.all() and np.bincount(shard).max() < 60 and len(np.unique(shard)) > 400
