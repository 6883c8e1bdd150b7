"""Windows over event time. Each function takes a batch or a stream and is the same plan for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of events, so many files a trigger."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder)


def late(events: DataFrame, delay: str) -> DataFrame:
    """Events that may be late by a delay; later ones are dropped from windows once these are closed."""
    return events.withWatermark("ts", delay)


def tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    got = late(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return late(events, delay).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no longer gap between them."""
    got = late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unique(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events once each; their ids are forgotten after the delay."""
    return late(events, delay).dropDuplicatesWithinWatermark(["event_id"])
