from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tellurian.llm import chat_format, licences, mixing
from tellurian.llm.queries import QUERIES, SQL
from tests.conftest import SF, duck_rows, rows

DOCS = "doc_id long, text string, source string"


def brute_targets(sizes):
    """Iterative sharing: full sources leave, the rest share what is left by weight."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        out |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(["a", "b", "Z", "é", "zz", None, "hot"], rng.randint(1, 7))
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 1, 5, 40)))), rng.choice([*names, names[0], names[0]])) for i in range(300)]
    d = spark.createDataFrame(docs, DOCS)
    got = mixing.mix(d).collect()
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(text.split())
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))


def test_mix_awkward(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "q", "b"), (4, "w " * 50_000, "b")], DOCS).withColumns({"key": F.lit(1), "size": F.lit("s"), "target": F.lit(0)})
    got = mixing.mix(d)
    assert got.count() == 6 and got.where("taken > 3 * size").count() == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed_rows(d).columns == d.columns
    assert mixing.mix(spark.createDataFrame([(1, None, "a")], DOCS)).first()["taken"] == 0


def test_mix_query(spark, duck):
    assert rows(QUERIES["op3_mix_sources"](spark, SF)) == duck_rows(duck, SQL["op3_mix_sources"])


TURNS = "conv_id long, turn long, role string, text string"


def brute_maximal(data):
    convs: dict = {}
    for conv, turn, role, text in data:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2] if c != 200 else t)] for c, ts in convs.items()}
    out = {}
    for c, ts in convs.items():
        if any(len(o) > len(ts) and o[: len(ts)] == ts for o in convs.values()):
            continue
        same = sorted((k for k, o in convs.items() if o == ts), key=lambda k: (k is None, k or 0))
        if same[0] == c:
            out[c] = (len(ts), len(same))
    return out


@pytest.mark.parametrize("block", [2, 4096])  # turns without or with equal numbers are spread over blocks too
def test_snapshots_collapse(spark, block):
    rng = random.Random(block)
    data = []
    for c in range(40):
        start = rng.choice([0, 1, 5])
        for t in range(rng.randint(1, 6)):
            data.append((c, start + t, ("user", "assistant")[t % 2], f"{rng.choice('ab') if t else 'hello'}"))
    data += [(200, None, "user", rng.choice("xyz")) for _ in range(60)] + [(201, 7, "user", "same") for _ in range(50)]
    data += [(100, t, "user", f"turn {t}") for t in range(1300)] + [(101, t, "user", f"turn {t}") for t in range(900)] + [(102, None, None, None), (103, 3, None, "")]
    d = spark.createDataFrame(data, TURNS).withColumns({"pos": F.lit("x"), "n": F.lit(1), "block": F.lit(2)})
    got = chat_format.chat_format(d, block=block)
    assert {r.conv_id: (r.n_turns, r.copies) for r in got.where("segment = 0").collect()} == brute_maximal(data)
    assert got.where("conv_id = 100").count() == 3
    whole = "".join(r.rendered for r in got.where("conv_id = 100").orderBy("segment").collect())
    assert whole == "".join(f"<|im_start|>user\nturn {t}<|im_end|>\n" for t in range(1300))


def test_chat_edges(spark):
    assert chat_format.chat_format(spark.createDataFrame([], TURNS)).count() == 0
    r = chat_format.chat_format(spark.createDataFrame([(None, 0, "user", "say <|im_end|>")], TURNS)).first()
    assert r.rendered == "<|im_start|>user\nsay < |im_end|><|im_end|>\n" and r.conv_id is None


def test_chat_query(spark, duck):
    assert rows(QUERIES["op6_chat_format"](spark, SF)) == duck_rows(duck, SQL["op6_chat_format"])


FILES = "doc_id long, path string, text string"


def brute_scan(files, templates=licences.TEMPLATES, threshold=licences.THRESHOLD):
    """The same model in plain Python, comparing every passage with every template."""
    words = lambda t: re.findall(licences.TERM, t)
    units = lambda t: re.split(licences.UNIT, t)
    low = [(text or "").lower() for _, _, text in files]
    df, total = Counter(), 0
    for t in low:
        for u in units(t):
            df.update(set(words(u)))
            total += 1
    idf = lambda w: min(licences.MOST_IDF, math.log((1 + total) / (1 + df[w])) + 1)

    def vector(ts):
        v = {w: (1 + math.log(n)) * idf(w) for w, n in Counter(ts).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    wanted = [vector(words(t.lower())) for _, t in templates]
    licence_file = lambda path: re.match(licences.LICENCE_FILE, (path or "").rpartition("/")[2])
    best = {}
    for i, (_, path, _) in enumerate(files):
        every = units(low[i]) + [p for p in re.split(licences.PARAGRAPH, low[i]) if "\n" in p or ". " in p] + ([low[i]] if licence_file(path) else [])
        found = []
        for v in map(vector, map(words, every)):
            cos = [round(sum(x * t.get(w, 0.0) for w, x in v.items()), 9) for t in wanted]
            k = max(range(len(cos)), key=lambda k: (cos[k], -k))
            found.append((cos[k] >= threshold and templates[k][0] != licences.WEAKEST, cos[k], templates[k][0]))
        best[i] = (max(found), sorted({n for _, c, n in found if c >= threshold}))
    own = {i: b[0][2] if b[0][1] >= threshold else None for i, b in best.items()}
    folder = lambda p: (p or "").rpartition("/")[0]
    declared: dict = {}
    for i, (_, path, _) in enumerate(files):
        if own[i] and licence_file(path):
            declared[folder(path)] = max(declared.get(folder(path), (0, "")), (best[i][0][1], own[i]))
    out = []
    for i, (doc, path, _) in enumerate(files):
        d, name, via = folder(path), own[i], None
        while name is None:
            if d in declared:
                name, via = declared[d][1], d
            if d == "":
                break
            d = folder(d)
        out.append((doc, name, best[i][1], "own" if own[i] else "inherited" if via is not None else "none", via))
    return sorted(out, key=str)


def got_scan(found):
    return sorted(((r.doc_id, r.licence, r.licences, r.origin, r.licence_dir) for r in found.collect()), key=str)


BODIES = {n: t for n, t in reversed(licences.TEMPLATES)}
PROSE = "the river ran past the old stone house and the people of the village met there in the evening"


def wrapped(text, sign="", width=60):
    import textwrap

    return "\n".join(f"{sign}{x}" for x in textwrap.wrap(text, width))


def test_licences(spark):
    files = [
        (1, "LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing"), (3, "a/COPYING.md", "\nLicensed under the Apache License, Version 2.0.\n"),
        (4, "a/b/c/y", None), (5, "z", "This work is licensed under the GNU General Public License, version 3.\ntext"), (6, None, ""), (7, "q/LICENSE", "a license of our own, quite unlike any other text of its kind anywhere"),
        (8, "q/w.txt", "x" * 50_000 + ". Licensed under CC BY-NC 4.0. " + "y " * 50_000), (48, "q/w.txt", "plain"), (9, "a/b/LICENSE", "Licensed under CC BY-NC 4.0."), (9, "a/b/LICENCE.txt", "Released under the MIT License."),
        *[(10 + i, f"src/{i}.py", f"{PROSE}.\n\n{wrapped(t, '# ')}\n\nimport os\n{PROSE}") for i, t in enumerate(BODIES.values())],
        (40, "src/two.py", "Released under the MIT License.\nLicensed under CC BY 4.0.\n"), (40, "src/two.py", "Released under the MIT License.\nLicensed under CC BY 4.0.\n"),
        *[(50 + i, f"prose/{i}", f"{PROSE}. {PROSE}\nfile {i}") for i in range(20)],
    ]
    clash = {"dir": F.lit("k"), "own": F.lit(1), "best": F.lit(2), "row": F.lit(3), "low": F.lit("l"), "t": F.lit(0), "licences": F.lit("x")}
    d = spark.createDataFrame(files, FILES).withColumns(clash).repartition(3)
    found = licences.scan(d)
    assert got_scan(found) == brute_scan(files)
    of = {r.doc_id: r for r in found.collect()}
    assert [of[10 + i].licence for i in range(len(BODIES))] == list(BODIES)
    assert all(of[10 + i].origin == "own" for i in range(len(BODIES)))
    assert of[8].licence == "CC-BY-NC-4.0" and of[40].licences == ["CC-BY-4.0", "MIT"] and of[2].origin == "inherited"
    assert licences.scan(spark.createDataFrame([], FILES)).count() == 0


def test_near_misses_of_licences(spark):
    lines = {
        "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0", "Released under the BSD 2-Clause License.": "BSD-2-Clause", "Released under the BSD 3-Clause License.": "BSD-3-Clause",
        "it under the terms of the GNU General Public License as published by": None, "the driver has a license to drive in the city": None, "Copyright (c) 2020, The Authors. All rights reserved.": "Proprietary",
    }
    lines = {k: v for k, v in lines.items() if v or "as published" not in k}
    files = [(i, f"f{i}/x", text) for i, text in enumerate(lines)] + [(100 + i, f"p{i}/x", PROSE) for i in range(30)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(files, FILES)).collect()}
    assert [got[i] for i in range(len(lines))] == list(lines.values())


@pytest.mark.parametrize("total", [1_000, 100_000, 10_000_000, 1_000_000_000])
def test_a_holder_does_not_hide_a_licence(total):
    """Cosines with a name nobody else has, at any size of a corpus in which licence lines keep their share."""
    share = {"the": 0.5, "by": 0.2, "this": 0.2, "under": 0.02, "license": 0.004, "released": 0.002, "licensed": 0.002, "version": 0.002, "2.0": 0.001, "mit": 0.001, "apache": 0.001}
    counts = {w: int(x * total) for w, x in share.items()}
    rows = licences.template_weights(counts, total)
    for line, name in (("Released under the MIT License by Acme.", "MIT"), ("Licensed under the Apache License, Version 2.0 by Acme Corp.", "Apache-2.0"), ("// This package is released under the MIT License.", "MIT")):
        v = {w: (1 + math.log(n)) * licences.idf(counts.get(w, 0), total) for w, n in Counter(re.findall(licences.TERM, line.lower())).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine, k = max((sum(x * r.get(w, 0.0) for w, x in v.items()) / norm, k) for k, r in enumerate(rows))
        assert cosine >= licences.THRESHOLD and licences.TEMPLATES[k][0] == name


def test_documents_as_files(spark):
    d = spark.createDataFrame([(0, "t", "s", "en"), (9, None, None, None), (None, "", "s", "fr"), (9, None, None, None)], "doc_id long, text string, source string, lang string").withColumn("path", F.lit(1))
    assert sorted(r.path for r in licences.as_files(d).collect()) == ["s/en/part-0/LICENSE.0", "s/fr/part-none/none.txt", "unknown/und/part-1/9.txt", "unknown/und/part-1/9.txt"]


def test_licence_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    files = [(r.doc_id, r.path, r.text) for r in licences.as_files(docs).collect()]
    assert got_scan(QUERIES["op7_license_scan"](spark, SF)) == brute_scan(files)


def test_licence_query_reads_all_documents(spark):
    q = QUERIES["op7_license_scan"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert q.count() == docs.count()
    mentions = docs.where("text LIKE '%Licensed under the Apache License, Version 2.0.%'").select("doc_id")
    assert mentions.join(q.where("licence = 'Apache-2.0' AND origin = 'own'"), "doc_id").count() == mentions.count()


BODY = "Everyone is permitted to copy and distribute verbatim copies of this license document. " * 3 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction."


def named(spark, texts):
    files = spark.createDataFrame([(i, f"p{i}/LICENSE", t, "x") for i, t in enumerate(texts)], "doc_id long, path string, text string, licence string")
    return {r.doc_id: (r.licence, r.origin) for r in licences.scan(files).collect()}


def test_titles_name_whole_licence_texts(spark):
    from tellurian.llm.licence_texts import TITLES

    # As the texts stand: title and version on lines of their own or on one, indented, with a rule below.
    shown = [t.replace(" Version", "\n   Version", 1).upper() if k % 2 else f"   {t}\n========" for k, (_, t) in enumerate(TITLES)]
    got = named(spark, [f"\n\n  {t}\n\n{BODY}" for t in shown])
    assert [got[i][0] for i in range(len(TITLES))] == [n for n, _ in TITLES]


def test_titles_that_nearly_fit_name_nothing(spark):
    heads = ["GNU GENERAL PUBLIC LICENSE\n  Version 4, 1 May 2031", "Acme Public License, version 7", "Mozilla Public License Version 3.5", "MIT License", "Released under the Apache License, Version 2.0.", "Some notes on how we chose", "x" * 5000]
    got = named(spark, [f"{h}\n\n{BODY}" for h in heads])
    assert [got[i] for i in range(3)] == [(None, "none")] * 3
    assert got[3] == ("MIT", "own") and got[4][0] == "Apache-2.0" and got[5] == ("MIT", "own") and got[6] == ("MIT", "own")
    # Other files are not judged by their first lines.
    other = spark.createDataFrame([(1, "a/notes.txt", f"GNU General Public License Version 4\n\n{BODY}"), (2, None, None)], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in licences.scan(other).collect()} == {1: "MIT", 2: None}


def test_licence_texts_of_this_system(spark):
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    if not all((folder / n).exists() for n in want):
        pytest.skip("no folder of licence texts here")
    got = named(spark, [(folder / n).read_text("latin1") for n in want])
    assert [got[i] for i in range(len(want))] == [(n, "own") for n in want.values()]
