"""The batch transformations on streams."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardline.functions import text as X
from wardline.operators import scan, trust


def findings_stream(skills: DataFrame) -> DataFrame:
    """Findings as they arrive. The analysis keeps no state, so any trigger and restart is safe."""
    return scan.findings_of(scan.analyze(skills))


def drift_stream(contents: DataFrame, lock: DataFrame) -> DataFrame:
    """``name, intact`` of arriving ``name, content`` rows against a static lock table."""
    hashed = contents.select("name", X.integrity(F.col("content")).alias("actual"))
    joined = hashed.join(lock.select("name", "integrity"), "name", "left")
    return joined.select("name", F.coalesce(F.col("actual") == F.col("integrity"), F.lit(False)).alias("intact"))


def utc_instant(ts: str) -> Column:
    """Zone-less times read as UTC, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))


def evidence_stream(evidence: DataFrame, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Evidence summed per node, signal and time window; the watermark bounds the state."""
    good, _ = trust.split_evidence(evidence)
    if dict(good.dtypes)["ts"] == "timestamp_ntz":
        good = good.withColumn("ts", utc_instant("ts"))
    sums = (
        good.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "node", "signal")
        .agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("pieces"))
    )
    return sums.select(F.col("window.start").alias("window_start"), "node", "signal", "delta", "pieces")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Process what is available now into Parquet under ``folder`` and stop.

    Progress and output live side by side in the given folder, which must be
    shared storage; running again continues where the last run ended.
    """
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file, a folder of files or partition folders.

    A plain path must be a folder to be streamed, and only below a plain path are the names
    of partition folders read; one file needs a pattern that only its own path matches.
    """
    files = spark.read.schema(schema).parquet(path).inputFiles()
    one = len(files) == 1 and unquote(files[0]).endswith("/" + path.rsplit("/", 1)[-1])
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]" if one else path)
