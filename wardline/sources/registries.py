"""Landed registry dumps as entry rows.

Dumps arrive as one JSON object per row in a ``payload`` column with a ``seq``;
``read_dump`` reads such lines from files. Nothing is fetched over the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import text as X
from wardline.plans.shape import pick


def read_dump(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """One payload per line, or per file where a document spans lines."""
    lines = spark.read.text(path, wholetext=whole_files).where(F.length("value") > 0)
    return lines.select(F.xxhash64("value").alias("seq"), F.col("value").alias("payload"))


def _text(*fields: Column) -> Column:
    return F.coalesce(*fields, F.lit(""))


def _shown(field: Column, chars: int | None) -> Column:
    return _text(field) if chars is None else F.substring(_text(field), 1, chars)


def mcp_entries(dump: DataFrame) -> DataFrame:
    """Server objects, alone, in an array or under ``servers``, with their alternative field names."""
    server = (
        "struct<name:string,id:string,url:string,repository:string,description:string,author:string,"
        "maintainer:string,version:string,stars:int,last_updated:string,updated_at:string>"
    )
    listed = F.from_json("payload", f"struct<servers:array<{server}>>")["servers"]
    array = F.when(F.col("payload").rlike(r"^\s*\["), F.from_json("payload", f"array<{server}>"))
    items = F.coalesce(listed, array, F.array(F.from_json("payload", server)))
    rows = dump.select("seq", F.posexplode(items).alias("pos", "e"))
    entries = rows.select(
        "seq",
        "pos",
        _text(F.col("e.name"), F.col("e.id")).alias("name"),
        _text(F.col("e.url"), F.col("e.repository")).alias("url"),
        _text(F.col("e.description")).alias("description"),
        _text(F.col("e.author"), F.col("e.maintainer")).alias("author"),
        _text(F.col("e.version")).alias("version"),
        F.coalesce("e.stars", F.lit(0)).alias("stars"),
        _text(F.col("e.last_updated"), F.col("e.updated_at")).alias("last_updated"),
    )
    return entries.where(F.col("name") != "")


def npm_entries(dump: DataFrame, shown_chars: int | None = None) -> DataFrame:
    """Search results; ``shown_chars`` cuts the description to what a registry listing shows."""
    package = (
        "struct<name:string,version:string,description:string,date:string,"
        "publisher:struct<username:string>,links:struct<npm:string>>"
    )
    objects = F.from_json("payload", f"struct<objects:array<struct<package:{package}>>>")["objects"]
    rows = dump.select("seq", F.posexplode(objects).alias("pos", "o")).select("seq", "pos", "o.package.*")
    fallback = F.concat(F.lit("https://www.npmjs.com/package/"), F.col("name"))
    entries = rows.select(
        "seq",
        "pos",
        "name",
        F.coalesce("links.npm", fallback).alias("url"),
        _shown(F.col("description"), shown_chars).alias("description"),
        _text(F.col("publisher.username")).alias("author"),
        _text(F.col("version")).alias("version"),
        F.lit(0).alias("stars"),
        _text(F.col("date")).alias("last_updated"),
    )
    return entries.where(F.coalesce("name", F.lit("")) != "")


def npm_metadata(dump: DataFrame) -> DataFrame:
    """``name, scripts, repository``: scripts of the version tagged latest, from the last document of a name."""
    schema = (
        "struct<name:string,repository:string,`dist-tags`:struct<latest:string>,"
        "versions:map<string,struct<scripts:map<string,string>>>>"
    )
    doc = F.from_json("payload", schema)
    rows = dump.select("seq", doc.alias("d"))
    latest = F.try_element_at("d.versions", F.col("d.`dist-tags`.latest"))
    found = rows.select("seq", "d.name", latest["scripts"].alias("scripts"), "d.repository").where("name IS NOT NULL")
    return pick(found, ["name"], ["seq"], last=True).drop("seq")


def pypi_entries(dump: DataFrame, shown_chars: int | None = None) -> DataFrame:
    """Package documents with their entry and metadata columns."""
    info = (
        "struct<name:string,project_url:string,summary:string,author:string,maintainer:string,version:string,"
        "description:string,requires_dist:array<string>>"
    )
    # An array of one: a test on what is parsed would be moved below and parse once more.
    parsed = F.array(F.from_json("payload", f"struct<info:{info}>")["info"])
    rows = dump.select("seq", F.explode_outer(parsed).alias("i"))
    project = F.concat(F.lit("https://pypi.org/project/"), F.col("i.name"), F.lit("/"))
    return rows.where("i IS NOT NULL").select(
        "seq",
        _text(F.col("i.name")).alias("name"),
        F.coalesce("i.project_url", project).alias("url"),
        _shown(F.col("i.summary"), shown_chars).alias("description"),
        _text(F.col("i.author"), F.col("i.maintainer")).alias("author"),
        _text(F.col("i.version")).alias("version"),
        F.lit(0).alias("stars"),
        F.col("i.maintainer").alias("maintainer"),
        F.col("i.requires_dist").alias("requires"),
        F.col("i.description").alias("long_description"),
        F.lit(True).alias("has_metadata"),
    )


def readme_texts(files: DataFrame) -> DataFrame:
    """``readme_key, readme`` from landed ``owner/repo/README.md`` files."""
    key = F.regexp_extract("path", r"([^/]+/[^/]+)/README\.md$", 1)
    return files.where(key != "").select(key.alias("readme_key"), X.strip(F.col("content")).alias("readme"))
