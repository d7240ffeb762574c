"""Skill Markdown files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.schemas import as_skills


def read_text_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, content`` with one row per file.

    Files are read as bytes and decoded per row, so a file that is not valid
    UTF-8 is set aside instead of failing the job.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("ignoreCorruptFiles", "true")
        .load(path)
    )
    readable = F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(readable).select("path", F.col("content").cast("string").alias("content"))


def skills_from_markdown(files: DataFrame) -> DataFrame:
    """Skill rows from ``seq, path, content``.

    Name and description come from flat frontmatter keys; the name falls back
    to the file stem. ``declared`` and ``version`` columns are used if present.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    parsed = files.select(
        "*", X.frontmatter_block(F.col("content")).alias("_front"), X.fences(F.col("content")).alias("_fences")
    )
    rows = parsed.select(
        "seq",
        F.coalesce(X.frontmatter_field(F.col("_front"), "name"), stem).alias("name"),
        *([F.col("version")] if "version" in files.columns else []),
        F.col("path").alias("source_path"),
        (F.col("format") if "format" in files.columns else F.lit("claude")).alias("format"),
        F.coalesce(X.frontmatter_field(F.col("_front"), "description"), F.lit("")).alias("description"),
        F.col("content").alias("instructions"),
        F.col("content").alias("raw_content"),
        *([F.col("declared_capabilities")] if "declared_capabilities" in files.columns else []),
        X.urls(F.col("content")).alias("urls"),
        X.env_in_prose(F.col("content")).alias("env_vars"),
        X.code_blocks(F.col("_fences")).alias("code_blocks"),
        X.shell_lines(F.col("_fences")).alias("shell_commands"),
    )
    return as_skills(rows)


def read_skill_folder(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """Skill rows of every Markdown file below a folder."""
    files = read_text_files(spark, path, glob)
    return skills_from_markdown(files.select(F.xxhash64("path").alias("seq"), "path", "content"))
