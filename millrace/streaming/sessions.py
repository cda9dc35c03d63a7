"""Sessions over a stream, closed by an event-time watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.web import SESSION_GAP_SECONDS


def stream_sessions(
    events: DataFrame,
    user: str,
    ts: str,
    value: Column | None = None,
    late: str = "1 hour",
    gap_seconds: int = SESSION_GAP_SECONDS,
) -> DataFrame:
    """Sessions per user in append mode: a session is emitted once no event can extend it, which is when
    the watermark (`late` behind the newest event) passes its end."""
    value = F.lit(0.0) if value is None else value
    # A pause of exactly the gap stays in the session: Spark's window does the same.
    window = F.session_window("_at", f"{gap_seconds} seconds")
    return (
        events.withColumn("_at", F.col(ts).cast("timestamp"))
        .withWatermark("_at", late)
        .groupBy(user, window.alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("value"))
        .select(
            user,
            F.unix_micros("w.start").alias("start_us"),
            (F.unix_micros("w.end") - gap_seconds * 1_000_000).alias("end_us"),
            "events",
            "value",
        )
    )
