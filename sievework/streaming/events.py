"""Structured Streaming forms: windows with late data, new files once, latest status, first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, each read exactly once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    """With ts as an event time: watermarks need a zoned timestamp."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key, with state bounded by the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def latest_status(log: DataFrame) -> DataFrame:
    """(id, status): the last status of each id of an append-only log (id, at, status)."""
    return log.groupBy("id").agg(F.max_by("status", "at").alias("status"))


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return its rows; for tests and backfills."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
