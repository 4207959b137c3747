"""Streams: documents landing in a folder, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Every batch transformed and written under its own id, each key once a batch; a repeated batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Events by tumbling window and type; with ``late`` a watermark bounds the state of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding_events(events: DataFrame, width: str, slide: str) -> DataFrame:
    grouped = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end after ``gap`` without an event."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("user_id", "first_ts", "last_ts", "n")
