"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.llm.byte_bpe import bpe_round_trip
from tellurian.llm.chat_format import chat_format
from tellurian.llm.exact_dedup import exact_dedup
from tellurian.llm.hard_negatives import hard_negatives
from tellurian.llm.language_id import language_id
from tellurian.llm.licences import as_files, scan
from tellurian.llm.mixing import mix
from tellurian.llm.order_minhash import edit_probe
from tellurian.llm.periodic_runs import run_probe
from tellurian.llm.quality import quality
from tellurian.llm.quality_rules import quality_rules
from tellurian.llm.simhash import simhash_dedup
from tellurian.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_probe(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(_table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"))
    return found.withColumn("broken", F.array_join("broken", ","))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), lambda vec_id: vec_id % 100 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_probe(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_mix_sources": op3_mix_sources,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_order_minhash": op5_order_minhash,
    "op6_chat_format": op6_chat_format,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op3_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS key
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
        w AS (
            SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS most,
                   (source_size * 3)::DOUBLE / [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS full_at FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () - (sum(most) OVER f - most))::DOUBLE / (sum(weight) OVER () - (sum(weight) OVER f - weight))::DOUBLE AS level
            FROM w WINDOW f AS (ORDER BY full_at, rank ROWS UNBOUNDED PRECEDING)),
        g AS (
            SELECT source, source_size, least(weight * (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, rank LIMIT 1), most::DOUBLE) AS target FROM l),
        b AS (
            SELECT *, least(round(target)::BIGINT, source_size * 3) AS budget FROM g),
        e AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
                   CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END AS rest FROM b),
        r AS (
            SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.rest,
                   sum(d.size) OVER (PARTITION BY d.source, d.key) AS tie,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS upto
            FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
        SELECT doc_id, size, source_size, target,
               (size * epochs + CASE WHEN upto <= rest THEN size WHEN upto - tie > rest OR tie = 0 THEN 0
                                     ELSE (rest - (upto - tie)) * size // tie END)::BIGINT AS taken
        FROM r
    """,
    "op6_chat_format": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations),
        p AS (
            SELECT *, string_agg(length(role) || ':' || length(text) || ':' || role || text, '')
                      OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pre FROM t),
        f AS (
            SELECT n, pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY n, pre),
        m AS (
            SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = f.n AND p.pre = f.pre))
        SELECT m.conv_id, (t.pos - 1) // 512 AS segment, any_value(m.n) AS n_turns, any_value(m.copies) AS copies,
               string_agg('<|im_start|>' || t.role || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS rendered
        FROM m JOIN t ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY m.conv_id, (t.pos - 1) // 512
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        x AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
        y AS (
            SELECT *, word = lag(word) OVER o AS stuttered,
                   CASE WHEN i <= n - 7 THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
                        lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) END AS eight
            FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        z AS (
            SELECT *, eight IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, eight) > 1 AS again FROM y),
        c AS (
            SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM z),
        g AS (
            SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words,
                   count(*) FILTER (stuttered) AS n_stuttered, count(*) FILTER (regexp_matches(word, '\p{L}')) AS n_lettered,
                   count(*) FILTER (trim(word, '.,;:!?"''()') IN (SELECT unnest(s || list_transform(s, lambda v: upper(v[1]) || v[2:])) FROM (SELECT string_split(
                       'the of and to a in is that for it was on with as be by this are from or at de la le les et des un une en que est pour du au dans sur qui el los las y se del por con para no der die und das von zu den mit sich nicht für ist im dem als ein eine auch', ' ') AS s))) AS n_stop_words
            FROM c GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
                   coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lettered, 0) AS n_lettered, coalesce(n_stuttered, 0) AS n_stuttered,
                   len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                   len(list_filter(l, lambda v: regexp_matches(v, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullets,
                   len(list_filter(l, lambda v: regexp_matches(v, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_cut_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM d LEFT JOIN g USING (doc_id)),
        r AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, concat_ws(',',
                CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words THEN 'word_length' END,
                CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END,
                CASE WHEN 10 * n_capitals > 3 * word_chars THEN 'capitals' END,
                CASE WHEN 50 * n_stop_words < n_words THEN 'stop_words' END,
                CASE WHEN 10 * n_lettered < 7 * n_words THEN 'lettered_words' END,
                CASE WHEN 10 * n_stuttered > n_words THEN 'repeated_neighbours' END,
                CASE WHEN 5 * n_dup_lines > 2 * n_lines THEN 'duplicate_lines' END,
                CASE WHEN 10 * n_bullets > 9 * n_lines THEN 'bullet_lines' END,
                CASE WHEN 10 * n_cut_lines > 3 * n_lines THEN 'cut_lines' END) AS broken
            FROM m)
        SELECT *, NOT base_failed AND broken = '' AS kept FROM r
    """,
    "op12_hard_negatives": """
        WITH e AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT p.anchor_id, p.positive_id, row_number() OVER r AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
        WINDOW r AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
        QUALIFY row_number() OVER r <= 10
    """,
}
