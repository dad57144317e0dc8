"""Sessions of timed events, one shuffle by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.clock import INSTANT, WALL, with_instants

USER = "user_id"


def _spans(rows: DataFrame, gap_minutes: int, time: str, instant: str) -> DataFrame:
    """Sessions with their lengths in microseconds, ``_us``."""
    w = Window.partitionBy(USER).orderBy("_us", "seq")
    own = with_instants(rows.filter(F.col(time).isNotNull()), time, instant)
    new = F.coalesce((F.col("_us") - F.lag("_us").over(w) > gap_minutes * 60_000_000).cast("int"), F.lit(0))
    named = own.select(USER, F.col(time).alias("_wall"), "_us", "seq", new.alias("new")).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("_us", "_wall")
    out = named.groupBy(USER, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))
    return out.select(USER, "session", F.col("first._wall").alias("start_ts"), F.col("last._wall").alias("end_ts"), "events", (F.col("last._us") - F.col("first._us")).alias("_us"))


def sessionise(rows: DataFrame, gap_minutes: int = 60, bonus_minutes: int = 5, time: str = WALL, instant: str = INSTANT) -> DataFrame:
    """``user_id, session, start_ts, end_ts, events, minutes``; a gap longer than ``gap_minutes`` starts a session.

    Gaps and minutes go by the instants (the column ``instant`` where rows have it), ``start_ts`` and ``end_ts`` are wall-clock times.
    """
    found = _spans(rows, gap_minutes, time, instant)
    return found.select(USER, "session", "start_ts", "end_ts", "events", (F.col("_us") / 1_000_000 / 60 + bonus_minutes).alias("minutes"))


def time_spent(rows: DataFrame, gap_minutes: int = 60, bonus_minutes: int = 5) -> DataFrame:
    """Totals and means of a user's sessions; lengths are added up in whole microseconds."""
    s = _spans(rows, gap_minutes, WALL, INSTANT).groupBy(USER).agg(F.count("*").alias("sessions"), F.sum("_us").alias("_us"), F.max("_us").alias("_longest"))
    days = rows.filter(F.col(WALL).isNotNull()).groupBy(USER).agg(F.count_distinct(F.to_date(WALL)).alias("days"))
    minutes, longest = F.col("_us") / 1_000_000 / 60 + bonus_minutes * F.col("sessions"), F.col("_longest") / 1_000_000 / 60 + bonus_minutes
    out = s.join(days, USER).select(USER, "sessions", "days", minutes.alias("minutes"), longest.alias("longest_minutes"))
    per = lambda c: F.col("minutes") / c
    return out.select(USER, "sessions", "minutes", per(60).alias("hours"), per(F.col("sessions")).alias("mean_minutes"), "longest_minutes", "days", per(F.col("days")).alias("minutes_per_day"))


def time_report(rows: DataFrame, gap_minutes: int = 60, bonus_minutes: int = 5) -> DataFrame:
    """``time_spent`` as it is shown: one decimal, and a sentence."""
    t = time_spent(rows, gap_minutes, bonus_minutes)
    hours = F.bround("hours", 1)
    span = F.when(hours >= 24, F.concat(F.floor(hours / 24).cast("string"), F.lit(" days "), F.floor(hours % 24).cast("string"), F.lit(" hours"))).otherwise(F.concat(hours.cast("string"), F.lit(" hours")))
    words = F.concat(F.lit("Spent approximately "), span, F.lit(" across "), F.col("days").cast("string"), F.lit(" days ("), F.col("sessions").cast("string"), F.lit(" sessions)"))
    return t.select(USER, F.bround("minutes", 1).alias("minutes"), hours.alias("hours"), F.bround("minutes_per_day", 1).alias("daily_minutes"), "days", "sessions", F.bround("mean_minutes", 1).alias("mean_minutes"), F.bround("longest_minutes", 1).alias("longest_minutes"), words.alias("summary"))


def binge_sessions(rows: DataFrame, minutes: int = 120, **options) -> DataFrame:
    """How many sessions last ``minutes`` and more, the longest one (the earlier on ties) and its date; zero and empty without any."""
    s = sessionise(rows, **options)
    long = F.col("minutes") >= minutes
    top = F.max_by(F.struct("minutes", "start_ts"), F.when(long, F.struct("minutes", -F.col("session"))))
    out = s.groupBy(USER).agg(F.count_if(long).alias("binges"), F.max(F.when(long, F.col("minutes"))).alias("longest_minutes"), top.alias("_t"))
    whole = F.coalesce(F.floor("longest_minutes"), F.lit(0))
    label = F.concat(F.floor(whole / 60).cast("string"), F.lit("h "), (whole % 60).cast("string"), F.lit("m"))
    day = F.when(F.col("binges") > 0, F.col("_t.start_ts"))
    return out.select(USER, "binges", "longest_minutes", label.alias("longest"), day.cast("date").alias("longest_date"), F.coalesce(F.date_format(day, "MMMM dd"), F.lit("")).alias("longest_day"))
