"""Mixing sources to target weights.

Every document gets a uniformly random key (a hash of its id).  Keys order each
source, and because they are uniform their leading digits are a range
partitioning into equal shares that needs no sampling: prefix sums of words are
taken first over (source, range) and then, inside the one range where a source's
budget runs out, over its keys.  So a source that holds most rows is spread over
all ranges, and only 1/4096 of it is ever sorted.  Whole epochs come first; the
remaining budget is cut at the exact word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellurian.llm.store import materialise

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """16 hex digits, uniform over documents and the same in every run."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> target: shares by weight, none above cap times its size.

    Filling by weight until sources are full ends where all sources that are not
    full share one level: sources in order of size / weight fill up first.  The
    table has one row per source and is ordered as a whole, in one task: a row is
    some 50 bytes, so that even millions of sources are one small sort.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = (
        sizes.withColumn("rank", F.row_number().over(rank))
        .withColumn("weight", F.element_at(F.lit(list(weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("full_at", F.col("most").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("weights", F.sum("weight").over(Window.partitionBy()))
        .withColumn("level", (F.col("total") - (F.sum("most").over(fill) - F.col("most"))).cast("double") / (F.col("weights") - (F.sum("weight").over(fill) - F.col("weight"))))
    )
    open_level = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))
    s = s.withColumn("at", F.min(open_level).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", F.least(F.col("weight") * F.col("at"), F.col("most").cast("double")).alias("target"))


def cuts(base: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its size, target, whole epochs and where the rest is cut.

    ``base`` has source, size and key.  Documents with a key below ``cut_key``
    are taken once more; those at it share ``cut_words`` of ``cut_size``.
    """
    ranges = base.groupBy("source", F.substring("key", 1, 3).alias("range")).agg(F.sum("size").alias("range_size"))
    goals = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap)
    goals = (
        goals.withColumn("budget", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_range = (
        ranges.withColumn("before", F.sum("range_size").over(by_range) - F.col("range_size"))
        .alias("r")
        .join(goals.select("source", "rest").alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .where("before <= rest AND rest < before + range_size")
        .select("r.source", "range", "before", "rest")
    )
    keys = (
        base.alias("b")
        .join(at_range.alias("a"), F.col("b.source").eqNullSafe(F.col("a.source")) & (F.substring("b.key", 1, 3) == F.col("a.range")))
        .groupBy("b.source", "key")
        .agg(F.sum("size").alias("key_size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_key = (
        keys.withColumn("at", F.col("before") + F.sum("key_size").over(by_key) - F.col("key_size"))
        .where("at <= rest AND rest < at + key_size")
        .select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("at")).alias("cut_words"), F.col("key_size").alias("cut_size"))
    )
    return goals.join(at_key, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "source_size", "target", "epochs", "cut_key", "cut_words", "cut_size")


def base_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"),
    )


def _taken(size: Column, key: Column, plan: str) -> Column:
    """Words taken of a document; ``plan`` is the prefix of the columns of its source's row in the table of cuts."""
    cut = lambda n: F.col(f"{plan}{n}")
    part = F.when(key < cut("cut_key"), size).when(key == cut("cut_key"), F.floor(cut("cut_words") * size / cut("cut_size"))).otherwise(0)
    return (size * cut("epochs") + part).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix",
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, epochs.

    ``taken`` counts the words that the mix takes of a document over all epochs,
    0 if none; the sum over a source is its target, rounded.  Null or blank texts
    have size 0 and take nothing; a null source is a source of its own, last in
    order.  Rows that repeat an id share its place in the order and, at the cut,
    its words by size.  An empty table gives an empty result.
    """
    base = materialise(base_table(docs, id_col, text_col, source_col, seed), "mix-base")
    plan = materialise(cuts(base, weights, cap), "mix-cuts")
    return (
        base.alias("b")
        .join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        .select("b.doc_id", "b.source", "b.size", "p.source_size", "p.target", _taken(F.col("b.size"), F.col("b.key"), "p.").alias("taken"), "p.epochs")
    )


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix",
) -> DataFrame:
    """The mixed corpus itself: each row of ``docs`` as often as the mix takes it.

    Documents stay whole: the one at the cut is taken once more if at least half
    of it lies inside the budget.  The texts are read in place and never shuffled;
    only the table of cuts meets them.
    """
    names = docs.columns
    base = materialise(base_table(docs, id_col, text_col, source_col, seed), "mix-base")
    plan = materialise(cuts(base, weights, cap), "mix-cuts")
    plan = plan.select([F.col(n).alias(f"__cut_{n}") for n in plan.columns])
    keyed = docs.withColumns({"__size": words(F.col(text_col)), "__key": random_key(F.col(id_col), seed)})
    joined = keyed.join(plan, F.col(source_col).cast("string").eqNullSafe(F.col("__cut_source")))
    times = F.when(F.col("__size") > 0, F.floor(_taken(F.col("__size"), F.col("__key"), "__cut_") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    repeated = joined.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return repeated.select(*[F.col(f"`{n}`") for n in names])
