"""Sessions as state: each user's open sessions are kept until the watermark passes them, then told once and forgotten.

A row joins the open sessions it lies within the gap of, also out of order, and may so merge two. A session is closed when the watermark is
past its last event and the gap: no row that is still accepted could reach it. Rows at or behind the watermark are dropped, which
is Spark's rule for late rows. So the state of a user holds the sessions of one gap and one delay, whatever the stream's length,
and a user without open sessions has no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from watchloom.functions.clock import micros, zoneless
from watchloom.session import shared_dir, ship

_OUT = "user_id long, start_us long, end_us long, events long"
_STATE = "starts array<long>, ends array<long>, events array<long>"
Session = tuple[int, int, int]


def merged(sessions: list[Session], times: list[int], gap_us: int) -> list[Session]:
    """Open sessions ``(start, end, events)`` after rows at ``times``; those at most ``gap_us`` apart are one."""
    out: list[Session] = []
    for start, end, n in sorted([*sessions, *((t, t, 1) for t in times)]):
        if out and start - out[-1][1] <= gap_us:
            out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
        else:
            out.append((start, end, n))
    return out


def split_closed(sessions: list[Session], watermark_us: int, gap_us: int) -> tuple[list[Session], list[Session]]:
    """Closed and open sessions at a watermark."""
    closed = [s for s in sessions if s[1] + gap_us < watermark_us]
    return closed, [s for s in sessions if s[1] + gap_us >= watermark_us]


def closing_sessions(events: DataFrame, gap_minutes: int = 60, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """``user_id, start_ts, end_ts, events`` of each session once it is closed; for a stream in append mode.

    The stream must not have a watermark of its own yet; rows without a time are left out.
    """
    gap_us = gap_minutes * 60_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        times = [int(t) for b in batches for t in b["us"]]
        closed, still = split_closed(merged([tuple(map(int, s)) for s in held], times, gap_us), state.getCurrentWatermarkMs() * 1000, gap_us)
        if still:
            state.update(tuple(list(c) for c in zip(*still)))
            # the first session to close; a timer must lie ahead of the watermark
            state.setTimeoutTimestamp(max(min(s[1] for s in still) + gap_us, state.getCurrentWatermarkMs() * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        if closed:
            starts, ends, counts = zip(*closed)
            yield pd.DataFrame({"user_id": key[0], "start_us": starts, "end_us": ends, "events": counts})

    ship(events.sparkSession)
    seen = events.select(F.col("user_id").cast("long"), micros(events, time).alias("us")).filter(F.col("us").isNotNull())
    marked = seen.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    out = marked.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("user_id", zoneless(F.col("start_us")).alias("start_ts"), zoneless(F.col("end_us")).alias("end_ts"), "events")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions that are still open, as ``closing_sessions`` tells closed ones, read from the state behind a stream's checkpoint."""
    kept = spark.read.format("statestore").load(checkpoint).select("key.user_id", "value.groupState.*")
    each = kept.select("user_id", F.explode(F.arrays_zip("starts", "ends", "events")).alias("s"))
    return each.select("user_id", zoneless(F.col("s.starts")).alias("start_ts"), zoneless(F.col("s.ends")).alias("end_ts"), F.col("s.events").alias("events"))


def append_to(stream: DataFrame, path: str, checkpoint: str | None = None):
    """Run a stream in append mode over all that is there now into a file sink; the same ``checkpoint`` goes on where it ended.

    The sink's own log makes each batch's files count once. Returns the query, for its progress.
    """
    checkpoint = checkpoint or shared_dir(stream.sparkSession)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)

