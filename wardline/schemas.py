"""Column layouts shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
_TEXTS = T.ArrayType(T.StringType())

# One row per parsed skill. ``seq`` carries input order, which Spark does not.
SKILL = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("name", _TEXT),
        T.StructField("version", _TEXT),
        T.StructField("source_path", _TEXT),
        T.StructField("format", _TEXT),
        T.StructField("description", _TEXT),
        T.StructField("instructions", _TEXT),
        T.StructField("declared_capabilities", _TEXTS),
        T.StructField("dependencies", _TEXTS),
        T.StructField("code_blocks", _TEXTS),
        T.StructField("urls", _TEXTS),
        T.StructField("env_vars", _TEXTS),
        T.StructField("shell_commands", _TEXTS),
        T.StructField("raw_content", _TEXT),
    ]
)
FINDING_FIELDS = ("severity", "message", "attack_class", "finding_type", "evidence")
FINDINGS_TYPE = "array<struct<severity:int,message:string,attack_class:string,finding_type:string,evidence:string>>"
CAPABILITIES_TYPE = "array<struct<resource:string,access:int>>"


def as_skills(df: DataFrame, **defaults: object) -> DataFrame:
    """Fill in missing skill columns and put all of them in order."""
    columns = []
    for field in SKILL.fields:
        if field.name in df.columns:
            value = F.col(field.name)
        elif field.name in defaults:
            value = F.lit(defaults[field.name])
        elif field.name == "version":
            value = F.lit("unknown")
        elif isinstance(field.dataType, T.ArrayType):
            value = F.array()
        else:
            value = F.lit("" if field.dataType == _TEXT else None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
