"""Document fingerprints by Order MinHash, in DataFrame functions only.

Word k-mers are numbered by occurrence, so that repeats count; a hash deals each
numbered k-mer into one of 64 bins (one-permutation hashing), the ``ELL``
smallest of a bin are kept, put back into text order and hashed as a tuple.  Two
texts agree in a bin if they share its smallest k-mers *and* their order, which
follows edit distance rather than set overlap.

Each step is its own projection over a packed array (39 bits of hash, 24 bits of
position), so that sorting runs on primitive arrays in generated code.  Both
widths are part of the definition: two different k-mers of a text are taken for
one with a chance of 1 in 5e11 a pair (their occurrences are then numbered
together, alike for equal texts), and the order of two picked k-mers more than
2**24 words into a text is that of their positions modulo 2**24.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurian.llm.store import materialise

K = 3
ELL = 2
BINS = 64
POS = 24
RANGE_ROWS = 1 << 20
LOW = (1 << POS) - 1
HIGH = ((1 << 63) - 1) & ~LOW


def _occurrence(ranked: Column, x: Column, at: Column) -> Column:
    """How many earlier elements of a sorted array share the hash of the one at ``at``.

    They stand directly before it, so their number is found by doubling steps:
    four for short runs, all 24 for long ones.
    """
    same = lambda d: F.get(ranked, at - d).bitwiseXOR(x) <= LOW
    climb = lambda top: F.aggregate(F.lit([1 << k for k in range(top - 1, -1, -1)]), F.lit(0), lambda d, step: F.when(same(d + step), d + step).otherwise(d))
    return F.when(same(F.lit(16)), climb(POS)).otherwise(climb(4))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column: 64 hex words of 8 digits, ``-`` for an empty bin.

    A null text counts as empty; a text of no words has an empty fingerprint
    string.  The last k - 1 words begin shorter k-mers, so that a text of fewer
    than k words has some too.
    """
    keep = df.columns
    step = lambda d, **cols: d.select(*keep, *[c.alias(n) for n, c in cols.items()])
    d = step(df, w=F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
    n = F.size("w")
    w = F.col("w")
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, K)]).bitwiseAND(F.lit(HIGH)).bitwiseOR(i.bitwiseAND(F.lit(LOW))))
    blank = (n == 1) & (w[0] == "")
    d = step(d, h=F.when(blank, F.array().cast("array<bigint>")).otherwise(hashed))
    d = step(d, s=F.sort_array("h"))
    s = F.col("s")
    numbered = F.transform(
        s,
        lambda x, j: F.when(
            F.get(s, j - 1).bitwiseXOR(x) <= LOW,
            F.xxhash64(x.bitwiseAND(F.lit(HIGH)), _occurrence(s, x, j)).bitwiseAND(F.lit(HIGH)).bitwiseOR(x.bitwiseAND(F.lit(LOW))),
        ).otherwise(x),
    )
    d = step(d, o=numbered)
    d = step(d, s=F.sort_array("o"))
    shift = 63 - (BINS.bit_length() - 1)
    bin_of = lambda x: F.shiftright(x, shift)
    picked = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - ELL).bitwiseXOR(x) >= (1 << shift), F.lit(True)))
    d = step(d, p=picked)
    # The picked elements are in bin order; a bin's one or two stand together.
    p = F.col("p")
    pos = lambda x: x.bitwiseAND(F.lit(LOW))
    high = lambda x: x.bitwiseAND(F.lit(HIGH))

    def tuple_hash(x: Column, j: Column) -> Column:
        other = F.get(p, j + 1)
        paired = other.isNotNull() & (bin_of(other) == bin_of(x))
        return F.when(~paired, F.xxhash64(high(x))).when(pos(x) <= pos(other), F.xxhash64(high(x), high(other))).otherwise(F.xxhash64(high(other), high(x)))

    signed = F.transform(p, lambda x, j: F.struct(bin_of(x).cast("int").alias("b"), tuple_hash(x, j).alias("t"), ((j == 0) | (bin_of(F.get(p, j - 1)) != bin_of(x))).alias("lead")))
    d = step(d, t=F.filter(signed, lambda x: x["lead"]))
    cells = F.map_from_arrays(F.col("t.b"), F.transform("t.t", lambda t: F.lower(F.lpad(F.right(F.hex(t), F.lit(8)), 8, "0"))))
    # One array holds the map, so that it is built once a text and not once a bin.
    filled = F.transform(F.array(cells), lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(m[b], F.lit("-"))))[0]
    return step(d, **{out: F.when(F.size("t") == 0, "").otherwise(F.array_join(filled, " "))})


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either fingerprint fills; 1 for two empty ones, 0 for one."""
    pairs = F.zip_with(F.split(a, " "), F.split(b, " "), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    filled = F.filter(pairs, lambda z: (z["x"] != "-") | (z["y"] != "-"))
    same = F.size(F.filter(filled, lambda z: z["x"] == z["y"])) / F.size(filled)
    return F.when((a == b), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(same)


def successors(ids: DataFrame) -> DataFrame:
    """rid, next_rid: each row's next in descending order of rid, the last one's the first.

    ``rid`` is unique.  Rows are range-partitioned, at most about ``RANGE_ROWS`` to
    a partition, and the partition numbers fixed in a table; neighbours are found
    inside a partition, and only the first row of each partition meets the others.
    """
    order = F.col("rid").desc()
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), ids.count() // RANGE_ROWS)
    ranged = materialise(ids.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "omh-order")
    inside = Window.partitionBy("part").orderBy(order)
    linked = materialise(ranged.select("rid", "part", F.lead("rid").over(inside).alias("next"), F.row_number().over(inside).alias("at")), "omh-links")
    heads = linked.where("at = 1").select("part", F.col("rid").alias("head"))  # one row per partition
    over = Window.orderBy("part")
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), first).alias("after"))
    return linked.join(heads, "part").select("rid", F.coalesce("next", "after").alias("next_rid"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each whole text; see :func:`with_fingerprint`."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(d, "text", "fingerprint").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n/2) code points replaced by the first as
    many (or all) of the next document's, by descending id; the last one's next
    is the first.  Null texts count as empty.  Texts that share an id are ordered
    by their hash, rows that repeat both are one document; a null id comes last;
    a single document follows itself; an empty table gives an empty result.

    Texts move once, partitioned by document, and that exchange serves both as
    the documents and as the source of their predecessors' new endings; of those
    only the code points that are needed move.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select(F.struct("doc_id", F.xxhash64("text").alias("tie")).alias("rid"), "text")
    halved = F.floor(F.char_length("text") / 2).cast("int")
    ids = materialise(d.select("rid", halved.alias("half")).distinct(), "omh-ids")
    back = successors(ids.select("rid")).join(ids, "rid").select(F.col("next_rid").alias("rid"), F.col("rid").alias("for_rid"), "half")
    full = with_fingerprint(d, "text", "fingerprint")
    tails = full.join(back, "rid").select(F.col("for_rid").alias("rid"), F.substring("text", F.lit(1), F.col("half")).alias("tail"), F.col("fingerprint").alias("next_fingerprint"))
    tails = tails.groupBy("rid").agg(F.first("tail").alias("tail"), F.first("next_fingerprint").alias("next_fingerprint"))
    n = F.char_length("text")
    both = full.join(tails, "rid").select("rid", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - halved), "tail").alias("edited"))
    done = with_fingerprint(both, "edited", "edited_fingerprint")
    return done.select(
        F.col("rid.doc_id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
