"""Chat formatting with cumulative-snapshot collapse.

Loggers often store a conversation once per turn, so that most logged
conversations are prefixes of longer ones.  Each turn is hashed with its place,
and the XOR of these hashes up to a turn is the rolling hash of that prefix (two
64-bit hashes, 128 bits).  XOR is associative, so a conversation of any length is
summed in blocks of turns and one conversation never has to fit one task.  A
conversation whose (length, hash) is the prefix of a longer one goes, by an
anti-join of distinct keys; of equal ones the smallest id stays.

Blocks are the parts of a range partitioning by conversation, turn and content,
whose numbers are fixed in a table: they are of equal size whatever the turn
numbers are, and only one row per conversation and block meets the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tellurian.llm.store import materialise

BLOCK = 1 << 17
SEGMENT = 512


def rolling_prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, pos, n (turns of the conversation), role, text, pa, pb (prefix hashes)."""
    content = ("role", "text")
    t = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in content])
    t = t.withColumns({"ca": F.xxhash64(F.lit("a"), *content), "cb": F.xxhash64(*content, F.lit("b"))})
    order = ("turn", "ca", "cb")
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // block + 1)
    # Rows that are alike in all four columns may stand in any order: a number spreads them.
    spread = t.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", *order, "tie")
    t = materialise(spread.withColumn("block", F.spark_partition_id()), "chat-blocks")
    inside = Window.partitionBy("conv_id", "block").orderBy(*order, "tie")
    blocks = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("__conv")
    on = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("block") == F.col("__block"))
    key = [F.col("conv_id").alias("__conv"), F.col("block").alias("__block")]
    counts = t.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("__conv", "__block", (F.sum("c").over(blocks) - F.col("c")).alias("skip"), F.sum("c").over(whole).alias("n"))
    t = t.withColumn("at", F.row_number().over(inside)).join(counts, on).withColumn("pos", F.col("at") + F.col("skip")).drop("__conv", "__block")
    t = t.withColumns({"ha": F.xxhash64("pos", "ca", "cb"), "hb": F.xxhash64("cb", "pos", "ca")})
    t = materialise(t.select("conv_id", "block", "pos", "n", "role", "text", "ha", "hb"), "chat-turns")
    sums = t.groupBy(*key).agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    sums = sums.select("__conv", "__block", F.bit_xor("xa").over(blocks).bitwiseXOR(F.col("xa")).alias("oa"), F.bit_xor("xb").over(blocks).bitwiseXOR(F.col("xb")).alias("ob"))
    ordered = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"wa": F.bit_xor("ha").over(ordered), "wb": F.bit_xor("hb").over(ordered)})
    return t.join(sums, on).select(
        "conv_id", "pos", "n", "role", "text",
        F.col("wa").bitwiseXOR(F.col("oa")).alias("pa"), F.col("wb").bitwiseXOR(F.col("ob")).alias("pb"),
    )


def chat_format(turns: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """conv_id, segment, n_turns, copies, rendered: the maximal conversations, as text.

    Turns are ordered by ``turn``, ties by content, and numbered anew, so gaps do
    not matter; a null turn comes first, a null role or text counts as empty, a
    null conv_id is one conversation.  ``copies`` counts the conversations that
    are equal turn by turn, of which the smallest conv_id is rendered.  A
    conversation is rendered in segments of 512 turns, one row each, whose texts
    concatenate; markers inside a turn's text are defused.  Any other column is
    ignored, an empty table gives an empty result.
    """
    p = materialise(rolling_prefixes(turns.select("conv_id", "turn", "role", "text"), block), "chat-prefixes")
    finals = p.where("pos = n").groupBy("n", "pa", "pb").agg(F.min("conv_id").alias("keep"), F.count(F.lit(1)).alias("copies"))
    longer = p.where("pos < n").select(F.col("pos").alias("n"), "pa", "pb").distinct()
    maximal = finals.join(longer, ["n", "pa", "pb"], "left_anti")
    # One row per segment, so that the turns of one conversation meet it on as many keys as it has segments.
    parts = maximal.select("keep", "copies", F.col("n").alias("n_turns"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / segment))).alias("at"))
    piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.replace(F.col("text"), F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))
    placed = p.withColumn("segment", F.floor((F.col("pos") - 1) / segment))
    return (
        placed.join(parts, F.col("conv_id").eqNullSafe(F.col("keep")) & (F.col("segment") == F.col("at")))
        .groupBy("conv_id", "segment")
        .agg(F.first("n_turns").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece")))).alias("pieces"))
        .select("conv_id", "segment", "n_turns", "copies", F.array_join("pieces.piece", "").alias("rendered"))
    )
