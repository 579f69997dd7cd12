"""Telemetry as a stream: the log's roll-ups kept up to date, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.sources.events import SCHEMA, clean


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The log's folder of JSON lines as a stream of events."""
    return clean(spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)).withColumn("ts", F.to_timestamp("timestamp"))


def running_by_language(events: DataFrame) -> DataFrame:
    """Totals by display language, for update or complete mode."""
    return events.groupBy(T.display_language(F.col("language")).alias("language")).agg(F.count("*").alias("requests"), F.sum("saved_tokens").alias("saved_tokens"))


def windowed(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by event-time window (tumbling, or sliding with ``slide``); rows later than ``late`` are dropped."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session: runs of a key's events less than ``gap`` apart."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def write_log(events: DataFrame, path: str, checkpoint: str):
    """A stream's events appended to the log's folder as JSON lines, each batch once; returns the query's writer.

    The file sink keeps a list of committed batches, so a batch that is run again after a failure isn't
    written twice, and readers of the folder see whole batches only.
    """
    fields = [F.col(f.name).cast(f.dataType) for f in SCHEMA if f.name in events.columns]
    return events.select(*fields).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
