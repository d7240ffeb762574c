"""Lock documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENTRY = (
    "struct<version:string,integrity:string,format:string,capabilities:array<string>,"
    "dependencies:map<string,string>,trust_score:double,trust_level:string,source_path:string>"
)
_META = "struct<total_skills:bigint,resolution_strategy:string,allowed_capabilities:array<string>>"


def lock_entries(documents: DataFrame) -> DataFrame:
    """One row per locked skill of ``seq, content`` documents, missing fields defaulted."""
    doc = F.from_json("content", f"struct<skills:map<string,{_ENTRY}>>")
    rows = documents.select("seq", F.explode(doc["skills"]).alias("name", "e"))
    return rows.select(
        "seq",
        "name",
        F.coalesce("e.version", F.lit("")).alias("version"),
        F.coalesce("e.integrity", F.lit("")).alias("integrity"),
        F.coalesce("e.format", F.lit("")).alias("format"),
        F.coalesce("e.capabilities", F.array().cast("array<string>")).alias("capabilities"),
        F.coalesce("e.dependencies", F.create_map().cast("map<string,string>")).alias("dependencies"),
        "e.trust_score",
        "e.trust_level",
        F.coalesce("e.source_path", F.lit("")).alias("source_path"),
    )


def lock_metadata(documents: DataFrame) -> DataFrame:
    """Header fields of each document; the skill count falls back to the entries found."""
    doc = F.from_json("content", f"struct<skills:map<string,string>,metadata:{_META}>")
    rows = documents.select("seq", doc.alias("d"))
    return rows.select(
        "seq",
        F.coalesce("d.metadata.total_skills", F.size("d.skills").cast("bigint")).alias("total_skills"),
        F.coalesce("d.metadata.resolution_strategy", F.lit("sat")).alias("resolution_strategy"),
        F.col("d.metadata.allowed_capabilities").alias("allowed_capabilities"),
    )
