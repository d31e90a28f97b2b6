"""Streaming counterparts: traces into daily folders, latencies by window, new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators.traces import with_day


def stream_to_daily(events: DataFrame, path: str, checkpoint: str, at: str = "ts") -> StreamingQuery:
    """Appends a stream of events as JSON, a folder a day, and ends when the source is read."""
    return with_day(events, at).writeStream.partitionBy("day").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window_start, event_type, events, total): tumbling windows, closed once the watermark has passed.

    Works on streams and on batches, with the same result for events that are not too late.
    """
    seen = events.withWatermark(at, late) if events.isStreaming else events
    grouped = seen.groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def new_files(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """A stream of files that appear in a folder; changes and deletions need the registry's diff."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)
