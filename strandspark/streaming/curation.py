"""Curation as a stream: the current state of each read and mate from an append-only event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "qname string, mate int, action string, record long, seq long, at timestamp"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).json(path)


def latest(events: DataFrame) -> DataFrame:
    """Last accept, unaccept or reset of each read and mate, as a running aggregate (update or complete mode)."""
    own = events.where(F.col("action").isin("accept", "unaccept", "reset"))
    last = F.max_by(F.when(F.col("action") == "accept", F.col("record")), F.col("seq"))
    return own.groupBy("qname", "mate").agg(last.alias("accepted"), F.max("seq").alias("seq"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind by window of event time; later ones than `late` are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "action").agg(F.count(F.lit(1)).alias("n"))
