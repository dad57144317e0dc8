"""Reports over windows of a stream: repeated rows dropped, channels looked up, closed windows appended.

All state is bounded by the watermark: a row's key is kept for deduplication until the watermark is past the row's time and the delay, a window's
counts until the watermark is past its end. Rows later than the delay are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.clock import micros, zoneless


def timed(events: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """Rows with a time, with their event time ``at`` and its watermark; a zoneless time is taken as UTC."""
    seen = events.withColumn("at", F.timestamp_micros(micros(events, time))).filter(F.col("at").isNotNull())
    return seen.withWatermark("at", late) if events.isStreaming else seen


def deduplicated(marked: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key; a repetition counts as one if it comes within the delay of the watermark."""
    return marked.dropDuplicatesWithinWatermark(list(keys)) if marked.isStreaming else marked.dropDuplicates(list(keys))


def window_report(events: DataFrame, channels: DataFrame | None = None, size: str = "1 day", slide: str | None = None, late: str = "2 hours", keys: tuple[str, ...] = ("user_id", "seq"), by: tuple[str, ...] = (), channel: str = "channel_clean", time: str = "ts") -> DataFrame:
    """``window_start, window_end, *by, watches, active, users`` of tumbling windows, or of sliding ones with ``slide``.

    ``channels`` is a table by ``channel``; ``by`` may name columns of it. Rows whose channel it lacks have nulls there. It is read anew in each batch
    of a stream and joined by Spark's choice, so it may be small or large. ``users`` is a distinct count from a sketch, exact to about 2 %.
    """
    rows = deduplicated(timed(events, late, time), keys)
    if channels is not None:
        rows = rows.join(channels, channel, "left")
    span = F.window("at", size, slide) if slide else F.window("at", size)
    counts = rows.groupBy(span.alias("w"), *by).agg(F.count("*").alias("watches"), F.count_if(F.col("engagement") == "active").alias("active"), F.approx_count_distinct("user_id", 0.02).alias("users"))
    edge = lambda c: zoneless(F.unix_micros(F.col(c)))
    return counts.select(edge("w.start").alias("window_start"), edge("w.end").alias("window_end"), *by, "watches", "active", "users")
