"""Reports in SQL text: table functions in Python, which say themselves how their input is to be dealt and sorted, and SQL functions over a view of events.

``install(spark, events)`` makes all of them known to a session; then for example

    SELECT * FROM watch_sessions(TABLE(watch_events), 60)
    SELECT * FROM day_streaks(TABLE(SELECT user_id, date(ts) AS date FROM watch_events), 3)
    SELECT * FROM top_channels_report(5) WHERE user_id = 7

A Python table function reads its partition row by row in order and keeps one session or streak, so a user may have any number of rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.types import DateType, DoubleType, LongType, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from watchloom.session import ship

VIEW = "watch_events"


def _number(argument: AnalyzeArgument | None, default: int, what: str) -> int:
    if argument is None:
        return default
    if not argument.isConstantExpression or argument.value is None or int(argument.value) <= 0:
        raise ValueError(f"{what} must be a positive constant")
    return int(argument.value)


def _typed(table: AnalyzeArgument, *columns: str) -> list:
    """Types of columns that the input table must have."""
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    have = {f.name: f.dataType for f in table.dataType.fields}
    for c in columns:
        if c not in have:
            raise ValueError(f"the input table has no column {c}")
    return [have[c] for c in columns]


class WatchSessions:
    """``user_id, session, start_ts, end_ts, events, minutes`` of rows with ``user_id, ts, seq``; gaps by ``ts_utc`` if there is such a column."""

    @staticmethod
    def analyze(events: AnalyzeArgument, gap_minutes: AnalyzeArgument | None = None, bonus_minutes: AnalyzeArgument | None = None) -> AnalyzeResult:
        user, time, _ = _typed(events, "user_id", "ts", "seq")
        _number(gap_minutes, 60, "the gap")
        _number(bonus_minutes, 5, "the bonus")
        instant = "ts_utc" if "ts_utc" in {f.name for f in events.dataType.fields} else "ts"
        schema = StructType().add("user_id", user).add("session", LongType()).add("start_ts", time).add("end_ts", time).add("events", LongType()).add("minutes", DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn(instant), OrderingColumn("seq")])

    def __init__(self):
        self.open, self.number, self.bonus = None, 0, 5

    def _told(self) -> tuple:
        user, start, end, first, last, n = self.open
        return user, self.number, start, end, n, (last - first) / dt.timedelta(microseconds=1) / 1_000_000 / 60 + self.bonus

    def eval(self, events: Row, gap_minutes: int = 60, bonus_minutes: int = 5) -> Iterator[tuple]:
        self.bonus = bonus_minutes
        wall = events["ts"]
        if wall is None:
            return
        at = events["ts_utc"] if "ts_utc" in events and events["ts_utc"] is not None else wall
        if self.open and at - self.open[4] <= dt.timedelta(minutes=gap_minutes):
            user, start, _, first, _, n = self.open
            self.open = (user, start, wall, first, at, n + 1)
            return
        if self.open:
            yield self._told()
            self.number += 1
        self.open = (events["user_id"], wall, wall, at, at, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self._told()


class DayStreaks:
    """``user_id, start, end, days`` of runs of consecutive dates in rows with ``user_id, date``; dates may repeat."""

    @staticmethod
    def analyze(dates: AnalyzeArgument, least: AnalyzeArgument | None = None) -> AnalyzeResult:
        user, _ = _typed(dates, "user_id", "date")
        _number(least, 3, "the least number of days")
        schema = StructType().add("user_id", user).add("start", DateType()).add("end", DateType()).add("days", LongType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("user_id")], orderBy=[OrderingColumn("date")])

    def __init__(self):
        self.run, self.least = None, 3

    def eval(self, dates: Row, least: int = 3) -> Iterator[tuple]:
        self.least, day = least, dates["date"]
        if day is None or self.run and day == self.run[2]:
            return
        if self.run and day - self.run[2] == dt.timedelta(days=1):
            self.run = (self.run[0], self.run[1], day, self.run[3] + 1)
            return
        if self.run and self.run[3] >= least:
            yield self.run
        self.run = (dates["user_id"], day, day, 1)

    def terminate(self) -> Iterator[tuple]:
        if self.run and self.run[3] >= self.least:
            yield self.run


_FUNCTIONS = (
    """view_bucket(n BIGINT) RETURNS STRING RETURN CASE WHEN n < 1 THEN NULL WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' ELSE '100+' END""",
    f"""hour_report() RETURNS TABLE (user_id BIGINT, hour INT, n BIGINT, percent DOUBLE) RETURN
  SELECT user_id, hour, n, n * 100D / sum(n) OVER (PARTITION BY user_id) FROM (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM {VIEW} WHERE type = 'watch' AND ts IS NOT NULL GROUP BY ALL)""",
    f"""top_channels_report(most INT DEFAULT 20) RETURNS TABLE (user_id BIGINT, rank INT, channel STRING, n BIGINT) RETURN
  SELECT user_id, r, channel_clean, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS r FROM
    (SELECT user_id, channel_clean, count(*) AS n, min(seq) AS s FROM {VIEW} WHERE type = 'watch' AND channel_clean IS NOT NULL GROUP BY ALL)) WHERE r <= most""",
    f"""bucket_report() RETURNS TABLE (user_id BIGINT, bucket STRING, channels BIGINT, videos BIGINT) RETURN
  SELECT user_id, bucket, count(*), sum(n) FROM (SELECT user_id, view_bucket(count(*)) AS bucket, count(*) AS n FROM {VIEW} WHERE type = 'watch' AND channel_clean IS NOT NULL GROUP BY user_id, channel_clean) GROUP BY ALL""",
)


def install(spark: SparkSession, events: DataFrame, view: str = VIEW) -> SparkSession:
    """Register the table functions, the view ``watch_events`` of ``events`` and the SQL functions over it.

    ``events`` has ``user_id`` (a whole number), ``seq, type, ts, channel_clean``. A second call replaces the view and the functions.
    """
    from pyspark.sql.functions import udtf

    ship(spark)
    events.createOrReplaceTempView(view)
    spark.udtf.register("watch_sessions", udtf(WatchSessions))
    spark.udtf.register("day_streaks", udtf(DayStreaks))
    for body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body.replace(VIEW, view)}")
    return spark
