"""The append-only logs as streams: rows arrive as files of JSON lines; state follows by key.

The batch operators read a log whole. A log that many writers add to is better
kept as a folder of files, each written once, and followed by a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New rows of a folder of JSON lines, with the file's time as ``at``."""
    return spark.readStream.schema(schema).json(folder).select("*", F.col("_metadata.file_modification_time").alias("at"))


def latest(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of each key, for output mode complete or update; one row of state a key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def per_window(rows: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys; rows later than ``late`` are dropped once their window has closed."""
    return rows.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
