"""Registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    align,
    bpe,
    conversation_repair,
    langid,
    line_rules,
    mixing,
    piece_bpe,
    pii,
    pq_dedup,
    quality_knn,
    sampling,
    sharding,
    sketch_dedup,
    toxicity,
)
from workloads.cases import Case, Query

CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        CASES[name] = Case(run, sql)
        return run

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _token_digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@case("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return _token_digests(bpe.decode(encoded, path))


@case("op11_pieces")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    encoded = piece_bpe.encode(docs, path).select("doc_id", "ids")
    return _token_digests(piece_bpe.decode(encoded, path))


@case("op3_langid")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs, sampling.remainder("doc_id", 4) != 2)
    return docs.select(
        "doc_id", sampling.held_out("doc_id", 4, 2).alias("held_out"), langid.identify(docs, model).alias("found")
    ).select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")


@case("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align.align(_documents(spark, sf_dir), *paths)


@case("op13_conversations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.repair(*conversation_repair.damaged(rows))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@case("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_knn.train(docs, _labels(spark, sf_dir), "quality", sampling.remainder("doc_id", 5) != 0)
    return docs.select(
        "doc_id", sampling.held_out("doc_id", 5, 0).alias("held_out"), quality_knn.score(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@case("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, _labels(spark, sf_dir), "toxic", sampling.remainder("doc_id", 4) != 2)
    return docs.select(
        "doc_id", sampling.held_out("doc_id", 4, 2).alias("held_out"), toxicity.score(docs, model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@case("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sharding.shard(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: Position of a part of a source's demand, per weight class, by the mixing schedules.
_POSITION = """
CASE weight WHEN 1 THEN 0.0::DOUBLE + 2.0::DOUBLE * part / (1.0::DOUBLE + sqrt(greatest(1.0::DOUBLE + 0.0::DOUBLE * part, 0.0::DOUBLE)))
WHEN 2 THEN 0.0::DOUBLE + 2.0::DOUBLE * part / (0.5::DOUBLE + sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * part, 0.0::DOUBLE)))
ELSE CASE WHEN part * 1.0625::DOUBLE >= 0.6875::DOUBLE
  THEN 0.5::DOUBLE + 2.0::DOUBLE * (part * 1.0625::DOUBLE - 0.6875::DOUBLE)
    / (1.25::DOUBLE + sqrt(greatest(1.5625::DOUBLE + -4.0::DOUBLE * (part * 1.0625::DOUBLE - 0.6875::DOUBLE), 0.0::DOUBLE)))
  ELSE 2.0::DOUBLE * (part * 1.0625::DOUBLE) / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE + -1.0::DOUBLE * (part * 1.0625::DOUBLE), 0.0::DOUBLE))) END END
"""

MIXED_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * sum(source_size) OVER below AS capped_before, sum(weight) OVER above AS open_weight,
         (SELECT sum(source_size) FROM sources) AS total
  FROM sources
  WINDOW below AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         above AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT (total - COALESCE(capped_before, 0))::BIGINT AS share, open_weight::BIGINT AS parts
  FROM ordered
  WHERE 3 * source_size::HUGEINT * open_weight >= weight * (total - COALESCE(capped_before, 0))
  ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1
), priced AS (
  SELECT s.*, CASE WHEN weight * share::HUGEINT > 3 * source_size::HUGEINT * parts THEN (3 * source_size)::DOUBLE
              ELSE (weight * share)::DOUBLE / parts::DOUBLE END AS target
  FROM sources s, level
), placed AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.weight, floor(p.target)::BIGINT AS goal,
         CASE WHEN p.source_size > 0 THEN floor(p.target)::BIGINT // p.source_size ELSE 0 END AS passes,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(COALESCE(d.doc_id::VARCHAR, '') || ':' || d.size), d.doc_id, d.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM sized d JOIN priced p ON d.source IS NOT DISTINCT FROM p.source
), taken AS (
  SELECT *, (passes * size + greatest(0, least(size, goal - passes * source_size - start)))::BIGINT AS taken,
         CASE WHEN goal > 0 THEN start::DOUBLE / goal::DOUBLE END AS part
  FROM placed
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN {_POSITION} END AS position FROM taken
"""


@case("op9_mixing", MIXED_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_documents(spark, sf_dir), ["doc_id"])
    return planned.orderBy(F.col("position").asc_nulls_last(), "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


CLEANED_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rn, doc_id, COALESCE(text, '') AS text,
         regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM docs)
), repeated AS (
  SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rn
), lines AS (
  SELECT rn, line, len(line) AS size,
         len(line) - len(replace(line, ' ', '')) AS gaps,
         len(line) - len(replace(line, '|', '')) AS bars,
         len(line) - len(replace(line, '!', '')) AS bangs,
         len(line) - len(translate(line, '#*$%&<>', '')) AS noise
  FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT rn, count(*) - count(DISTINCT line) AS dup, sum(size)::BIGINT AS chars,
         COALESCE(sum(size) FILTER (WHERE
           (bars >= 2 AND bars * 4 >= gaps) OR noise * 10 > size OR (bangs >= 6 AND bangs * 2 > gaps)
           OR (gaps >= 10 AND NOT regexp_matches(line, '__PUNCTUATION__'))
           OR 10 * len(regexp_extract(line, '(?i)(accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign up (now|today)|subscribe to our|enable javascript|log in to|back to top|skip to content|licensed under|released under)')) >= len(line)
         ), 0)::BIGINT AS lost
  FROM lines GROUP BY rn
), measured AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         len(array_to_string(w, ''))::BIGINT AS word_chars,
         (len(text) - len(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         COALESCE(dup, 0)::BIGINT AS n_dup_lines, COALESCE(c.n, 0)::BIGINT AS n_repeat_words,
         COALESCE(lost, 0)::BIGINT AS n_lost_chars, COALESCE(chars, 0) AS chars
  FROM docs d LEFT JOIN covered c USING (rn) LEFT JOIN judged USING (rn)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_chars,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT 100 * n_lost_chars > 40 * chars AS kept
FROM measured
""".replace("__PUNCTUATION__", line_rules.PUNCTUATION)


@case("op4_line_rules", CLEANED_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(_documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_lost_chars",
        "base_failed",
        "kept",
    )


@case("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.transform("_base", lambda x: x["k"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listing(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        pii.listing(F.concat("_base", "_more")).alias("spans"),
        F.size("_more").cast("long").alias("n_more"),
    )


@case("op7_near_copies")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return sketch_dedup.classes(docs, shingle_words=4).select("doc_id", "n_shingles", "component_id", "kept")


@case("op6_vectors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
