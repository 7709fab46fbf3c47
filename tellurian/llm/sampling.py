"""Bounded samples of labelled rows, drawn alike at every size.

Two parameters bound what reaches the driver: a number of rows, chosen by hash
on ids alone, and a number of bytes of text, taken in the same random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurian.llm.store import materialise

#: Most bytes of text that a sample brings to the driver.
SAMPLE_BYTES = 64 << 20


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample_hash(key: str) -> Column:
    return F.xxhash64(F.lit("sample"), F.col(key))


def _below(n: Column, total: Column) -> Column:
    """The hash below which about four times ``n`` of ``total`` uniform hashes lie."""
    return F.least(-9.2e18 + 1.84e19 * 4.0 * n / total, F.lit(9.2e18)).cast("long")


def smallest(df: DataFrame, n: int, key: str = "doc_id", total: int | None = None) -> DataFrame:
    """The ``n`` distinct keys with the smallest hashes, a row of each: a random sample that reruns agree on.

    Hashes are uniform, so a threshold with ample room is applied first; without
    it every task would send its own ``n`` candidates.
    """
    h = sample_hash(key)
    total = df.count() if total is None else total
    if total > 16 * n:
        df = df.where(h < _below(F.lit(float(n)), F.lit(float(total))))
    return df.dropDuplicates([key]).orderBy(h, key).limit(n)


def smallest_of_each(df: DataFrame, n: int, by: str, key: str = "doc_id") -> DataFrame:
    """:func:`smallest` for each value of ``by``, so that a rare value is never missing.

    The threshold is a value's own, so that the rows which are ranked are a few
    times ``n`` for each value, however many it has.  ``by`` is a class to learn:
    its values, a row each, are as many as a classifier's outputs.
    """
    totals = df.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__total"))
    limits = totals.select("__by", F.when(F.col("__total") > 16 * n, _below(F.lit(float(n)), F.col("__total"))).alias("__below"))
    near = df.join(F.broadcast(limits), F.col(by) == F.col("__by")).where(F.col("__below").isNull() | (sample_hash(key) < F.col("__below"))).drop("__by", "__below")
    order = Window.partitionBy(by).orderBy(sample_hash(key), key)
    return near.dropDuplicates([by, key]).withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= n).drop("__at")


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, per_class: int, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` rows of each of the two classes outside the held-out fold.

    Ids are chosen on the label table alone; the chosen ones, whose number the
    parameter bounds, are sent to the documents.  An id that has both labels
    teaches nothing and is left out; other columns of ``labels`` are ignored.
    """
    given = labels.where(~held_out).select("doc_id", F.col(label).cast("int").alias("label")).where("label IS NOT NULL AND doc_id IS NOT NULL")
    agreed = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other AND label IN (0, 1)").drop("other")
    chosen = smallest(agreed.where("label = 1"), per_class).unionByName(smallest(agreed.where("label = 0"), per_class))
    return [(r.text or "", r.label) for r in texts_of(docs, chosen, most_bytes)]


def texts_of(docs: DataFrame, chosen: DataFrame, most_bytes: int = SAMPLE_BYTES) -> list:
    """Rows (doc_id, text, and the other columns of ``chosen``) in order of id; ids that repeat give one row.

    ``chosen`` has distinct ids, as few as the caller's bound.  Rows are taken in
    order of their hash until their texts have ``most_bytes`` together; texts are
    never cut.
    """
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    once = materialise(found.groupBy(*chosen.columns).agg(F.min("text").alias("text")), "sample")
    # As many short rows as were chosen.
    sizes = once.select("doc_id", sample_hash("doc_id").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()
    left, taken = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if r.size > left:
            continue
        left -= r.size
        taken.append(r.doc_id)
    if len(taken) < len(sizes):
        once = once.where(F.col("doc_id").isin(taken))
    return sorted(once.collect(), key=lambda r: r.doc_id)
