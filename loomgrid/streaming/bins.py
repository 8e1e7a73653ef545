"""Counts over windows of time as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Rows and values by window and type; on a stream, state older than the watermark is dropped."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, pattern: str | None = None, files_per_batch: int = 4) -> DataFrame:
    """Parquet files of a folder as a stream of events."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", pattern) if pattern else r).parquet(folder)


def run_once(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that is there now, through the streaming engine into a table in memory."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
