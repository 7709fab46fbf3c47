"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

DataFrame functions only.  A file's passages are its units (lines and sentences),
its paragraphs (lines joined up to a blank one, comment signs falling away with
all other signs) and, of a file that is named like a licence, the whole text.

*Weights.*  Document frequencies are counted for every term over the units of all
files.  A term weighs (1 + ln tf) x idf with idf = ln((1 + N) / (1 + df)) + 1,
at most ``MOST_IDF``: a holder's name then weighs no more than the rarest word of
a licence, whatever the size of the corpus.  It also bounds what is broadcast:
terms below that ceiling have df > N / e^7, of which there are at most 1,100 for
each distinct term that a unit has on average.

*Candidates.*  A squared cosine is at most the product of two shares: that of the
template's squared length and that of the passage's which their common terms
hold.  So a passage that reaches the threshold T must hold a term from outside
the template's lightest terms that stay below T^2 together, and the product of
bounds of both shares must reach T^2.  Passages that fail are left out before
anything moves, which loses none.  The others' terms are counted, weighed and
compared with all templates.

*Titles.*  The whole text of a public licence stands under a title that names it and
its version.  A licence file is judged by the cosine of its first line, or first
two, to those titles: at ``TITLE`` or more the title names the file, whatever its
passages resemble.  Where the head names a licence and a version that no title
has, the file has none: its text is then a licence that is not known, and what it
shares with others says nothing.  Only files without such a head are declared by
their passages.

*Inheritance.*  A file without a licence of its own takes that of the licence
file in its nearest ancestor directory: distinct directories are unfolded into
their ancestors, joined to the licence files' directories, and the deepest wins.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellurian.llm.licence_texts import TEMPLATES, TITLES
from tellurian.llm.store import materialise

THRESHOLD = 0.5
MOST_IDF = 8.0
#: Cosine of a head to the title that names it, and the terms that a head has at most.
TITLE = 0.9
HEAD_TERMS = 40
#: A head that is the title of a licence with its version, and words that a title has not.
TITLED = r"^\W*(\w+[\s,-]+){1,8}licen[cs]e\W+(v|version)\W*[0-9][0-9.]*(\W.{0,30})?$"
STATED = r"\b(under|licen[cs]ed|this|is|by|see|identifier)\b"
#: Declares nothing where another licence stands beside it.
WEAKEST = "Proprietary"
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
UNIT = r"\n|(?<=[.!?])(?<!\bv\.)[ \t]+"
PARAGRAPH = r"\n[\s#*/;%!>|-]*\n"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\..*)?$"


def terms(passage: Column) -> Column:
    return F.regexp_extract_all(passage, F.lit(TERM), F.lit(0))


def units(text: Column) -> Column:
    """Lines and sentences of a lower-cased text."""
    return F.split(text, UNIT)


def passages(text: Column, is_licence: Column) -> Column:
    """Units, paragraphs of more than one, and the whole text of a licence file."""
    several = F.filter(F.split(text, PARAGRAPH), lambda p: p.contains("\n") | p.contains(". "))
    return F.concat(units(text), several, F.when(is_licence, F.array(text)).otherwise(F.array().cast("array<string>")))


def term_counts(texts: DataFrame) -> DataFrame:
    """(t, df): how many units hold each term; the empty term counts the units."""
    found = F.flatten(F.transform(units(F.col("low")), lambda u: F.concat(F.array(F.lit("")), F.array_distinct(terms(u)))))
    return texts.select(F.explode(found).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))


def idf(df: float, total: int) -> float:
    return min(MOST_IDF, math.log((1 + total) / (1 + df)) + 1)


def template_weights(counts: dict[str, int], total: int, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[dict[str, float]]:
    """The terms of each template with their weights, of length one together."""
    out = []
    for _, text in templates:
        row = {w: (1 + math.log(n)) * idf(counts.get(w, 0), total) for w, n in Counter(re.findall(TERM, text.lower())).items()}
        norm = math.sqrt(sum(x * x for x in row.values()))
        out.append({w: x / norm for w, x in row.items()})
    return out


def telling_terms(rows: list[dict[str, float]], threshold: float = THRESHOLD) -> set[str]:
    """Terms of which a passage must hold one to come within the threshold of any template."""
    out: set[str] = set()
    for row in rows:
        light = 0.0
        for w, x in sorted(row.items(), key=lambda r: (r[1], r[0])):
            light += x * x
            if light >= threshold * threshold:
                out.add(w)
    return out


#: Bounds by which weights are told apart before they are counted: idf of template terms, idf of others, shares of a template.
IDF_STEPS = (1.5, 2.0, 3.0, 4.0, 6.0, MOST_IDF)
COMMON = (3.0, 5.0)
SHARE_STEPS = (0.003, 0.006, 0.01, 0.016, 0.025, 0.04, 0.06, 0.1, 0.15, 0.25, 0.5, 1.0)
SHORT_TEMPLATE = 20


def likely(read: Column, vocabulary: dict[str, float], common: list[list[str]], rows: list[dict[str, float]], threshold: float) -> Column:
    """Those of an array of passages (as arrays of terms) whose bounds allow a cosine of ``threshold``.

    ``vocabulary`` has the idf of every template term; ``common`` the other terms
    below each idf in ``COMMON``.  Of a passage, the share of its squared weight
    that lies in template terms is bounded from above: (1 + ln n)^2 is at most
    1.5 n, and every other term weighs its idf at least.  So is the share of a
    template that its terms cover, by each term's greatest share in any short and
    in any long template.
    """
    ranges = lambda steps: list(zip((0.0, *steps), steps, strict=False))
    by_idf = [([w for w, x in vocabulary.items() if low < x <= high], high * high) for low, high in ranges(IDF_STEPS)]
    others = [(ws, float(x * x)) for ws, x in zip(common, (1.0, *COMMON), strict=False)]
    shares = []
    for group in ([r for r in rows if len(r) <= SHORT_TEMPLATE], [r for r in rows if len(r) > SHORT_TEMPLATE]):
        most = {w: max(r.get(w, 0.0) for r in group) ** 2 for r in group for w in r}
        shares.append([([w for w, x in most.items() if low < x <= high], high) for low, high in ranges(SHARE_STEPS)][::-1])
    sum_of = lambda ts, levels, other: F.aggregate(ts, F.lit(0.0), lambda a, t: a + _levels(t, levels, other))
    words = sorted(vocabulary)
    parted = F.transform(read, lambda ts: F.struct(ts.alias("ts"), F.filter(ts, lambda t: t.isin(words)).alias("known"), F.filter(ts, lambda t: ~t.isin(words)).alias("other")))
    parted = F.filter(parted, lambda p: F.size(p["known"]) > 0)
    bounds = F.transform(parted, lambda p: F.struct(
        p["ts"].alias("ts"), (1.5 * sum_of(p["known"], by_idf[::-1], 0.0)).alias("inside"), sum_of(F.array_distinct(p["other"]), others, float(COMMON[-1] ** 2)).alias("outside"),
        F.greatest(*[sum_of(F.array_distinct(p["known"]), s, 0.0) for s in shares]).alias("cover"),
    ))
    kept = F.filter(bounds, lambda p: p["inside"] * F.least(p["cover"], F.lit(1.0)) >= threshold * threshold * (p["inside"] + p["outside"]))
    return F.transform(kept, lambda p: p["ts"])


def _levels(t: Column, levels: list[tuple[list[str], float]], other: float) -> Column:
    """The value of the first list that holds a term."""
    out = None
    for words, value in levels:
        if words:
            out = F.when(t.isin(words), value) if out is None else out.when(t.isin(words), value)
    return F.lit(other) if out is None else out.otherwise(other)


def best_matches(found: DataFrame, counts: DataFrame, total: int, rows: list[dict[str, float]], names: list[str], threshold: float) -> DataFrame:
    """row -> licence, cosine, licences: the best of a row's candidate passages and all licences that they reach.

    ``found`` has row and candidates, an array of passages' terms.
    """
    spark = found.sparkSession
    # Terms below the ceiling: a bounded number, see the module's head.
    known = counts.where((F.col("t") != "") & (F.col("df") + 1 > (total + 1) * math.exp(1 - MOST_IDF)))
    known = known.select("t", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    vocabulary = sorted(set().union(*rows))
    table = F.lit(json.dumps([{"t": w, "share": [r.get(w, 0.0) for r in rows]} for w in vocabulary]))
    shares = spark.range(1).select(F.inline(F.from_json(table, "array<struct<t: string, share: array<double>>>")))
    held = found.select("row", F.posexplode("candidates").alias("passage", "ts")).select("row", "passage", F.explode("ts").alias("t")).groupBy("row", "passage", "t").agg(F.count(F.lit(1)).alias("n"))
    weighed = held.join(F.broadcast(known), "t", "left").join(F.broadcast(shares), "t", "left")
    w = (1 + F.log("n")) * F.coalesce("idf", F.lit(idf(0, total)))
    weighed = weighed.select("row", "passage", "share", w.alias("w"))
    dots = [F.sum(F.col("w") * F.coalesce(F.get("share", F.lit(k)), F.lit(0.0))).alias(f"d{k}") for k in range(len(rows))]
    sums = weighed.groupBy("row", "passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    each = F.array(*[F.struct((F.col(f"d{k}") / F.col("norm")).alias("cosine"), F.lit(-k).alias("k")) for k in range(len(rows))])
    top = sums.select("row", F.array_max(each).alias("top"))
    top = top.select("row", F.round("top.cosine", 9).alias("cosine"), F.element_at(F.lit(names), 1 - F.col("top.k")).alias("licence"))
    reached = F.col("cosine") >= threshold
    order = F.struct(reached & (F.col("licence") != WEAKEST), F.col("cosine"), F.col("licence"))
    return top.groupBy("row").agg(F.max(order).alias("best"), F.sort_array(F.collect_set(F.when(reached, F.col("licence")))).alias("licences")).select(
        "row", F.when(F.col("best.cosine") >= threshold, F.col("best.licence")).alias("own"), F.col("best.cosine").alias("cosine"), "licences"
    )


def heads(low: Column) -> Column:
    """The first line that has a term, and the first two together; longer ones than a title are left out."""
    lines = F.slice(F.filter(F.split(F.left(low, F.lit(1 << 12)), "\n"), lambda x: F.rlike(x, F.lit("[a-z0-9]"))), 1, 2)
    both = F.array(F.get(lines, F.lit(0)), F.array_join(lines, " "))
    return F.filter(both, lambda x: x.isNotNull() & (F.size(terms(x)).between(1, HEAD_TERMS)))


def title_of(head: Column, rows: list[dict[str, float]], weight: dict[str, float]) -> Column:
    """struct(cosine, k) of the nearest title to an array of heads; a head's terms count once, an unknown one weighs the most."""
    idfs = F.create_map(*[F.lit(x) for w in sorted(weight) for x in (w, weight[w])])
    of = lambda t: F.coalesce(F.try_element_at(idfs, t), F.lit(MOST_IDF))
    shares = [F.create_map(*[F.lit(x) for w in sorted(r) for x in (w, r[w])]) for r in rows]
    total = lambda ts, f: F.aggregate(ts, F.lit(0.0), lambda a, t: a + f(t))

    def nearest(x: Column) -> Column:
        ts = F.array_distinct(terms(x))
        norm = F.sqrt(total(ts, lambda t: of(t) * of(t)))
        return F.array_max(F.array(*[F.struct((total(ts, lambda t, s=s: of(t) * F.coalesce(F.try_element_at(s, t), F.lit(0.0))) / norm).alias("cosine"), F.lit(-k).alias("k")) for k, s in enumerate(shares)]))

    return F.array_max(F.transform(head, nearest))


def scan(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, titles: Sequence[tuple[str, str]] = TITLES,
) -> DataFrame:
    """doc_id, path, licence, licences, cosine, origin, licence_dir: one row per file.

    ``origin`` is ``own`` where a licence file has a known title or a passage of the
    file reaches the threshold with a template, ``inherited`` where an ancestor directory (the nearest, its own
    included) holds a licence file that does, else ``none`` with null licence.
    ``licences`` are all that a file's passages reach, each passage counting for
    its nearest template; ``licence`` is the nearest of them, a bare reservation
    of rights only where nothing else is found.  Of several licence files in a
    directory the nearest to a template counts, ties by the greater name.

    Null and empty texts have no terms and no cosine; a null path lies in the
    root; rows that repeat are rows of their own, alike in all they get; a text of
    any length is read whole; other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit(""))
    name, folder = F.regexp_extract("path", r"[^/]*$", 0), F.regexp_replace("path", r"/?[^/]*$", "")
    given = files.select(F.col(f"`{id_col}`").alias("doc_id"), path.alias("path"), F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("low"))
    counts = materialise(term_counts(given.select("low")), "licence-terms")
    vocabulary = sorted({w for _, t in templates for w in re.findall(TERM, t.lower())})
    title_terms = sorted({w for _, t in titles for w in re.findall(TERM, t.lower())})
    of = {r.t: r.df for r in counts.where(F.col("t").isin("", *vocabulary, *title_terms)).collect()}  # at most the templates' terms
    total = of.pop("", 0)
    rows = template_weights(of, total, templates)
    telling = sorted(telling_terms(rows, threshold))
    given = given.withColumn("is_licence", name.rlike(LICENCE_FILE))
    read = F.transform(passages(F.col("low"), F.col("is_licence")), terms)
    # At most e^4 for each distinct term that a unit has on average.
    others = counts.where((F.col("t") != "") & ~F.col("t").isin(vocabulary) & (F.col("df") + 1 > (total + 1) * math.exp(1 - COMMON[-1]))).collect()
    common = [sorted(r.t for r in others if low <= idf(r.df, total) < high) for low, high in zip((0.0, *COMMON), COMMON, strict=False)]
    weight = {w: idf(of.get(w, 0), total) for w in vocabulary}
    candidates = likely(F.filter(read, lambda ts: F.exists(ts, lambda t: t.isin(telling))), weight, common, rows, threshold)
    head = F.when(F.col("is_licence"), heads(F.col("low")))
    title = title_of(head, template_weights(of, total, titles), {w: idf(of.get(w, 0), total) for w in title_terms}) if titles else F.lit(None).cast("struct<cosine: double, k: int>")
    titled = F.coalesce(F.exists(head, lambda x: F.rlike(x, F.lit(TITLED)) & ~F.rlike(x, F.lit(STATED))), F.lit(False))
    found = given.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", folder.alias("dir"), "is_licence", candidates.alias("candidates"), title.alias("title"), titled.alias("titled"))
    found = materialise(found, "licence-passages")
    best = best_matches(found.where(F.size("candidates") > 0), counts, total, rows, [n for n, _ in templates], threshold)
    named = F.coalesce(F.col("title.cosine") >= TITLE, F.lit(False))
    by_title = F.element_at(F.lit([n for n, _ in titles] or [""]), 1 - F.col("title.k"))
    rated = found.select("row", "doc_id", "path", "dir", "is_licence", "title", "titled").join(best, "row", "left")
    rated = materialise(rated.select(
        "row", "doc_id", "path", "dir", "is_licence", F.when(named, by_title).when(~F.col("titled"), F.col("own")).alias("own"),
        F.when(named, F.round("title.cosine", 9)).otherwise(F.col("cosine")).alias("cosine"),
        F.when(named, F.array(by_title)).when(~F.col("titled"), F.col("licences")).alias("licences"),
    ), "licence-files")
    declared = rated.where("is_licence AND own IS NOT NULL").groupBy(F.col("dir").alias("licence_dir")).agg(F.max(F.struct("cosine", "own")).alias("d"))
    declared = declared.select("licence_dir", F.col("d.own").alias("licence"))
    parts = F.split("dir", "/")
    steps = rated.where("own IS NULL").select("dir").distinct()
    steps = steps.select("dir", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up", "licence_dir"))
    nearest = steps.join(declared, "licence_dir").groupBy("dir").agg(F.min(F.struct("up", "licence", "licence_dir")).alias("near"))
    joined = rated.join(nearest, "dir", "left")
    inherited = F.col("own").isNull() & F.col("near").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("own", F.col("near.licence")).alias("licence"), F.coalesce("licences", F.array().cast("array<string>")).alias("licences"), F.round("cosine", 6).alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").otherwise("none").alias("origin"),
        F.when(inherited, F.col("near.licence_dir")).alias("licence_dir"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files source/lang/part-k/name: every eighth id is named LICENSE, the others by their id.

    The name does not depend on the text.  Null sources, languages and ids have
    names of their own; rows that repeat share a path.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    name = F.when(F.pmod("doc_id", F.lit(8)) == 0, F.concat(F.lit("LICENSE."), key)).otherwise(F.concat(key, F.lit(".txt")))
    shard = F.concat(F.lit("part-"), F.coalesce(F.pmod(F.floor(F.col("doc_id") / 8), F.lit(8)).cast("string"), F.lit("none")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), shard, name).alias("path"))
