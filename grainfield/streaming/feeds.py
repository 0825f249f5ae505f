"""Streams: the same counts kept up to date over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def contribution_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Contributions as a stream of Parquet files."""
    schema = "id long, type string, contributor string, created_at timestamp"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(stream: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, type, n) of contributions a window; rows later than the watermark are left out, repeated ids count once within it."""
    once = stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("created_at", window).alias("w"), F.lower(F.trim("type")).alias("type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")
