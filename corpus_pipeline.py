"""Language ID, exact dedup, near dedup, mixing and tokenising, in this order.

Each stage reads what its predecessor kept and, but for the last, returns the
columns of ``documents``, whatever other columns there are and however they are
named (names that begin with two underscores are the stages' own).  Every stage
takes null ids, texts, languages and sources, empty and very long texts, rows
that repeat and an empty table; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.llm import language_id as lid
from tellurian.llm.byte_bpe import bpe_round_trip
from tellurian.llm.exact_dedup import exact_dedup
from tellurian.llm.mixing import mixed_rows
from tellurian.llm.simhash import simhash_dedup
from tellurian.llm.store import mark, materialise, release

#: A language is recognised from this share of the way between chance and certainty.
#: The least score of the 17,404 texts under 400 letters of a test table of four languages was 0.315, of a text
#: that is mostly an address and a number; the bound is 0.265 there.
LEAST_OVER_CHANCE = 0.02


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; those without a letter, those that fit none and those of no learned language go.

    The network names one of the languages that it knows, whatever it reads; a
    text stays if its letters are also about as likely as those of learned texts
    (``language_id.Statistics``: a bound from held-out documents).  A null or empty
    text has no letter.  Texts are read whole and each row on its own, so rows that
    repeat stay or go together; ids, languages and sources of any kind, null too,
    are kept as they are.  Where no row has a language to learn from, nothing is
    recognised and all rows go.
    """
    rows = lid.sample_rows(docs)
    net = lid.train(rows)
    least = 0.0 if net is None else (1 + LEAST_OVER_CHANCE * (len(net.languages) - 1)) / len(net.languages)
    found = lid.identify(docs, net, keep=tuple(docs.columns), pred="__lang", score="__score", known=("__known", lid.Statistics(rows)))
    return found.where((F.col("__lang") != lid.UNDETERMINED) & (F.col("__score") >= least) & F.col("__known")).select(*[F.col(f"`{n}`") for n in docs.columns])


def with_row_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for each row, written once so that all readers see the same keys."""
    return materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")


def only(docs: DataFrame, keyed: DataFrame, best: Column, groups: DataFrame) -> DataFrame:
    """Of each group of (row key, group) pairs the row whose struct ``best`` is least, as rows of ``docs``."""
    ranked = groups.toDF("__row", "__group").join(keyed.select("__row", "doc_id"), "__row")
    kept = ranked.groupBy("__group").agg(F.min(best)["__row"].alias("__row")).select("__row")
    return keyed.join(kept, "__row", "left_semi").select(*[F.col(f"`{n}`") for n in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest id.

    A null id ranks below all others and null texts count as empty; of rows with
    equal texts and equal or no ids the first one stays, so that of rows which
    repeat one is left.  Texts are compared whole.
    """
    keyed = with_row_keys(docs)
    best = F.struct(F.col("doc_id").isNull(), F.bitwise_not("doc_id"), F.col("__row"))
    return only(docs, keyed, best, exact_dedup(keyed, "__row").select("doc_id", "keep_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints one row stays, that with the smallest id.

    A null id ranks behind all others; of rows with equal or no ids the first one
    stays.  Null, empty and blank texts have fingerprint zero and are one group.
    Whole texts are read.
    """
    keyed = with_row_keys(docs)
    best = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    return only(docs, keyed, best, simhash_dedup(keyed, "__row").select("doc_id", "component_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the source mix asks for, which may be never.

    Null, empty and blank texts have no words and are never taken.  A null source
    is a source of its own; rows that repeat an id share its place in the order;
    the document at a budget's cut is taken whole if half of it lies inside.
    """
    return mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed corpus, a row for each of its rows.

    Null and empty texts have no tokens; rows that repeat are coded alike; texts
    are coded whole.
    """
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]

#: Neither the network nor the merges can be said in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again as the next one's input.

    What a stage wrote on its way is deleted once its output stands, so that no
    more than two stages' tables are there at any time.
    """
    since = mark(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, since, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
