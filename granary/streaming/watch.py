"""Watch a folder: new files are searched as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.search import all_hits


def watch_files(spark: SparkSession, root: str, patterns: list[bytes], per_trigger: int = 1_000) -> DataFrame:
    """Streaming (path, pattern, offset) of signature hits in the files that appear below ``root``."""
    schema = spark.read.format("binaryFile").load(root).schema
    stream = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", per_trigger).load(root)
    )
    return all_hits(stream, "path", "content", patterns)


def watch_events(spark: SparkSession, folder: str, schema, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming counts and sums of events by type and window, closed by a watermark."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )
