"""Continuous ingest and windows over event streams. The reference has no streams of data; these are extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import index_table


def upsert_stream(nodes: DataFrame, path: str, checkpoint: str, key: str = "key") -> StreamingQuery:
    """Each micro-batch replaces rows of its keys; doing one again changes nothing."""

    def put(batch: DataFrame, epoch: int) -> None:
        index_table.upsert(batch.sparkSession, path, batch, key)

    return nodes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_of_each(nodes: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return nodes.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, tumbling or sliding; the same plan on a stream and a table."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if events.isStreaming else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
