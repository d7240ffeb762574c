"""The corpus pipeline: stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of documents. Texts that change get their new n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, langid, mixing, pii, sampling, sketch_dedup
from wardline.plans.stages import Stages
from workloads.cases import Case

TOKENIZER = "byte_bpe_50k.json"
SHINGLE_WORDS = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language can be told of: those without any letter, and those that fit no codeword.

    Where no language could be learned, only those without any letter go.
    """
    model = langid.train(docs, sampling.remainder("doc_id", 4) != 2)
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), langid.identify(docs, model).alias("_found"))
    kept = (F.col("_found.lang_pred") != langid.UNKNOWN) & ~F.col("_found.foreign")
    return found.where(kept).select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies."""
    return sketch_dedup.deduplicate(docs, SHINGLE_WORDS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    return _measured(pii.redact(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources in training order, a row per copy."""
    return _measured(mixing.mix(docs), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and a digest of what they decode to."""
    vocabulary = bpe.load_vocabulary(public_tokenizers.path(TOKENIZER))
    encoded = bpe.encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    return bpe.decode(encoded, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    size = F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return changed.withColumn("n_chars", size).select(*docs.columns) if "n_chars" in docs.columns else changed


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Sketches, bootstrapping and merge rounds are not expressible on whole tables in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder."""
    stages = Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


CASE = Case(run, ORACLE_SQL)
