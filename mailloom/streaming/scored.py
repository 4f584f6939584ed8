"""Streams: scored messages, windowed counts with late data, and one request per key within the cache's time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.operators import scoring
from mailloom.operators.reviewer import TTL_SECONDS


def score_stream(emails: DataFrame, **options) -> DataFrame:
    """A stream of messages with their scores. Scoring looks at one row at a time, so it is the batch operator."""
    return scoring.score(emails, **options)


def window_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, total value): tumbling windows; in a stream, events later than `late` are dropped.

    A time without zone is read as UTC in a session that is set to UTC."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    return e.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(session_start, session_end, key, n): runs of events with pauses shorter than the gap."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", late) if events.isStreaming else e
    return e.groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_requests(requests: DataFrame, time: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """The requests of a stream that a cache of that time would not answer: per (model, digest) the first, and
    the next one when the state of the first has expired behind the watermark. State is bounded by the time."""
    return requests.withWatermark(time, f"{ttl} seconds").dropDuplicatesWithinWatermark(["model", "digest"])
