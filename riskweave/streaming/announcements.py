"""Announcements' events as a stream: each event counts once, in windows that slide by the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_key string, company string, label string, severity int, published_at timestamp"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files_at_once: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def window_counts(events: DataFrame, days: int = 30, step: int = 1, late: str = "2 days") -> DataFrame:
    """Events and grave ones (severity 4 and more) of each company in windows of so many days.

    A repeated event_key within `late` counts once. State is bounded by the watermark: what comes later than that is left out, windows
    are final when it has passed them. Works on a static DataFrame too."""
    if events.isStreaming:
        rows = events.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["event_key"])
    else:
        rows = events.dropDuplicates(["event_key"])
    counted = rows.groupBy(F.window("published_at", f"{days} days", f"{step} days"), "company").agg(
        F.count("*").alias("events"), F.count_if(F.col("severity") >= 4).alias("high_events")
    )
    return counted.select("company", F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), "events", "high_events")


def write_counts(counts: DataFrame, path: str, checkpoint: str):
    """Final windows appended as Parquet; all that is there is worked off, then the query ends. Restarts go on from the checkpoint."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
