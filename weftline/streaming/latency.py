"""Structured Streaming over event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_latency(events: DataFrame, at: str = "ts", stage: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window_start, stage, n, milliseconds) per tumbling window; rows later than ``late`` are left out of closed windows."""
    w = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), F.col(stage).alias("stage"))
    return w.agg(F.count("*").alias("n"), F.timestamp_diff("MILLISECOND", F.min(at), F.max(at)).alias("milliseconds")).select(F.col("window.start").alias("window_start"), "stage", "n", "milliseconds")


def run_available(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what a stream holds now as parquet and stop; a later call goes on where this one ended."""
    query = frame.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
