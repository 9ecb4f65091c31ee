"""Event-time windows over attempts and heartbeats; the same plans run on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_name


def heartbeat_sessions(beats: DataFrame, lease: str = "180 seconds", late: str = "10 minutes") -> DataFrame:
    """(device, started, lapsed, beats): a session ends where no heartbeat follows within the lease."""
    beats = beats.withWatermark("ts", late) if beats.isStreaming else beats
    out = beats.groupBy("device", F.session_window("ts", lease).alias("w")).agg(F.count("*").alias("beats"))
    return out.select("device", F.col("w.start").alias("started"), F.col("w.end").alias("lapsed"), "beats")


def outcome_windows(attempts: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, outcome, n): outcomes by tumbling or sliding windows of their start."""
    attempts = attempts.withWatermark("started_at", late) if attempts.isStreaming else attempts
    out = attempts.groupBy(F.window("started_at", size, slide).alias("w"), "outcome").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "outcome", "n")


def stream_first_seen(cards: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each name's first card of a search, on a stream; a name may come again once the watermark has passed it."""
    cards = cards.withColumn("norm_name", normalize_name("name")).withWatermark("ts", late)
    return cards.dropDuplicatesWithinWatermark(["query_id", "norm_name"])
