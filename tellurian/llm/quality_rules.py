"""Quality rules: a threshold table compiled into one projection, in DataFrame functions only.

A rule bounds the ratio of two measures of a text.  :data:`RULES` is the table;
:func:`compile_rules` turns it into one column, which compares cross products of
whole numbers and so never rounds.  Measures are whole numbers too; each is an
expression over the text, its words and its lines, evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
_BLANK = " \t\n\x0b\x0c\r"
_PUNCTUATION = ".,;:!?\"'()"

#: Function words of the four languages, each also with a capital.
STOP_WORDS = (
    "the of and to a in is that for it was on with as be by this are from or at "
    "de la le les et des un une en que est pour du au dans sur qui "
    "el los las y se del por con para no "
    "der die und das von zu den mit sich nicht für ist im dem als ein eine auch"
).split()


@dataclass(frozen=True)
class Rule:
    """``least`` <= 1000 * numerator / denominator <= ``most``; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    least: int | None = None
    most: int | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.numerator) * 1000, F.col(self.denominator)
        ok = F.lit(True)
        if self.least is not None:
            ok = ok & (part >= whole * self.least)
        if self.most is not None:
            ok = ok & (part <= whole * self.most)
        return ok


#: Thresholds in thousandths.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2500, 12000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("capitals", "n_capitals", "word_chars", None, 300),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("lettered_words", "n_lettered", "n_words", 700, None),
    Rule("repeated_neighbours", "n_stuttered", "n_words", None, 100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("bullet_lines", "n_bullets", "n_lines", None, 900),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
)


def compile_rules(rules: Sequence[Rule]) -> Column:
    """Names of the rules that a row breaks, in the order of the table; empty where it keeps them all."""
    broken = [F.when(~r.holds(), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _shifted(a: Column, i: Column) -> Column:
    """The element at ``i``, null beyond the ends."""
    return F.when(i >= 0, F.get(a, i))


def measures(docs: DataFrame, text_col: str = "text", keep: Sequence[str | Column] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and the measures that rules can name, all long.

    n_words, word_chars, n_symbols, n_capitals (A-Z), n_stop_words, n_lettered
    (words with a letter), n_stuttered (words equal to the one before), n_lines
    (lines with a word), n_dup_lines (of those, equal to an earlier one),
    n_bullets, n_cut_lines (that end in an ellipsis), n_repeat_words.

    A repeated window is found on its 64-bit hash: windows go into one sorted
    array of long values, the leading bits of the hash above as many bits as the
    position needs, and neighbours are compared on the whole hash.  Where two
    different hashes share their leading bits, hash and position are sorted as
    pairs instead, so that the count does not depend on the packing.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    step = lambda d, **cols: d.select(*names, *[c.alias(n) for n, c in cols.items()])
    col, get, big = F.col, F.get, lambda c: c.cast("long")
    d = docs.select(*[(col(f"`{k}`") if isinstance(k, str) else k).alias(n) for n, k in zip(names, keep, strict=True)], F.coalesce(col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    d = step(d, t=col("t"), l=lines, w=F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    w, line, n = col("w"), col("l"), F.size("w")
    stop = [*STOP_WORDS, *[s[0].upper() + s[1:] for s in STOP_WORDS]]
    # Hashes of 1, 2, 4 and at last 8 words; those that run over the end are cut off.
    paired = lambda a, by: F.zip_with(a, F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    windows = F.slice(paired(paired(paired(w, 1), 2), 4), 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    counted = {
        "n_words": n,
        "word_chars": F.char_length(F.array_join("w", "")),
        "n_symbols": F.size(F.split("t", r"[#*$%&|<>]", -1)) - 1,
        "n_capitals": F.size(F.split("t", "[A-Z]", -1)) - 1,
        "n_stop_words": F.size(F.filter(w, lambda x: F.btrim(x, F.lit(_PUNCTUATION)).isin(stop))),
        "n_lettered": F.size(F.filter(w, lambda x: F.rlike(x, F.lit(r"\p{L}")))),
        "n_stuttered": F.size(F.filter(w, lambda x, i: x == _shifted(w, i - 1))),
        "n_lines": F.size(line),
        "n_dup_lines": F.size(line) - F.size(F.array_distinct(line)),
        "n_bullets": F.size(F.filter(line, lambda x: F.left(F.ltrim(x, F.lit(_BLANK)), F.lit(1)).isin("-", "*", "•"))),
        "n_cut_lines": F.size(F.filter(line, lambda x: F.endswith(F.rtrim(x, F.lit(_BLANK)), F.lit("...")) | F.endswith(F.rtrim(x, F.lit(_BLANK)), F.lit("…")))),
    }
    none = F.array().cast("array<bigint>")
    counted = {k: big(v) for k, v in counted.items()}
    kept = {k: col(k) for k in counted}
    d = step(d, **counted, h=F.when(n > WINDOW, windows).otherwise(none))
    d = step(d, **kept, h=F.when(F.size(F.array_distinct("h")) < F.size("h"), col("h")).otherwise(none))
    h = col("h")
    # A power of two above every position.
    m = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(big(F.size("h")))))
    d = step(d, **kept, h=h, m=m, s=F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(-m).bitwiseOR(big(i)))))
    s, m = col("s"), col("m")
    hash_at = lambda x: get(h, x.bitwiseAND(m - 1).cast("int"))
    mixed = F.exists(F.zip_with(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, y: (x.bitwiseAND(-m) == y.bitwiseAND(-m)) & (hash_at(x) != hash_at(y))), lambda b: b)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), big(i).alias("i"))))
    exact = F.transform(F.filter(F.transform(pairs, lambda x, j: F.struct(x["i"].alias("i"), F.coalesce(x["h"] == _shifted(pairs, j - 1)["h"], F.lit(False)).alias("a"), F.coalesce(x["h"] == get(pairs, j + 1)["h"], F.lit(False)).alias("b"))), lambda x: x["a"] | x["b"]), lambda x: x["i"])
    same = lambda x, y: F.coalesce(hash_at(x) == hash_at(y), F.lit(False))
    packed = F.transform(F.filter(s, lambda x, j: same(x, _shifted(s, j - 1)) | same(x, get(s, j + 1))), lambda x: x.bitwiseAND(m - 1))
    d = step(d, **kept, p=F.sort_array(F.when(F.size(s) == 0, none).when(mixed, exact).otherwise(packed)))
    p = col("p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = step(d, **kept, n_repeat_words=covered)
    return d.select(*[col(k).alias(n) for k, n in zip(names, [k if isinstance(k, str) else f"__k{i}" for i, k in enumerate(keep)], strict=True)], *counted, "n_repeat_words")


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, all measures, base_failed, kept, and ``broken``, the rules that the text breaks.

    A text fails the base with fewer than 20 words, or with more than 30 % of its
    words in repeated windows; it is kept if it passes the base and breaks no rule.
    A null text counts as empty: it has no words and fails the base.  Texts are
    read whole and each row on its own, so rows that repeat are answered alike,
    null ids stay null, and an empty table gives an empty result.
    """
    found = measures(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    found = found.withColumns({"base_failed": failed, "broken": compile_rules(rules)})
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
