"""Event streams: tumbling and session windows with watermarks, the same for a stream and a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) by tumbling windows; on a stream, later events than the watermark are left out."""
    rows = _timed(events, late)
    return rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): runs of a user's events no further apart than the gap."""
    rows = _timed(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def streamed(spark: SparkSession, folder: str, file: str, transform, mode: str = "complete") -> DataFrame:
    """The rows that a stream over the files of a folder with this name (or pattern) gives when all of them have been read:
    readStream, the transformation, writeStream. Only what an aggregation keeps comes into the result's table."""
    name = f"stream_{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", file).parquet(folder).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    transform(events).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
