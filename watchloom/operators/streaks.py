"""Daily baselines, unusual days and weeks, chains of dates, habits.

All but the first step work on daily aggregates, which are small for each user.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = "user_id"


def _by_user():
    return Window.partitionBy(USER)


def daily_hours(rows: DataFrame) -> DataFrame:
    """``user_id, date, hour, n``, and ``s``, the first row of the hour: at most 24 rows a day."""
    return rows.filter(F.col("ts").isNotNull()).groupBy(USER, F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.min("seq").alias("s"))


def daily(rows: DataFrame) -> DataFrame:
    """Per date the total, the late ones, the peak hour and ``hours``, the counts of all 24 hours."""
    slots = F.array(*[F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n"))), F.lit(0)) for h in range(24)])
    return daily_hours(rows).groupBy(USER, "date").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("hour") < 5, F.col("n")).otherwise(0)).alias("late"), F.max_by("hour", F.struct("n", -F.col("s"))).alias("peak_hour"), slots.alias("hours")
    )


def baseline(days: DataFrame) -> DataFrame:
    return days.groupBy(USER).agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("sigma"), (F.sum("late") / F.sum("total")).alias("late_share"), F.count("*").alias("days"))


def _last(rows: DataFrame, n: int, *order: str) -> DataFrame:
    w = _by_user().orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def late_night_days(days: DataFrame, least: int = 3, last: int | None = 20) -> DataFrame:
    out = days.filter(F.col("late") >= least).select(USER, "date", "late", "total", "peak_hour")
    return _last(out, last, "date") if last else out


def binge_days(days: DataFrame, least: int = 10, last: int | None = 20, sigmas: float = 2.0) -> DataFrame:
    """Days above mean + ``sigmas`` sigma (twice the mean if sigma is 0) and ``least`` or more.

    The test is ``days * total - sum > sigmas * sqrt(days * squares - sum * sum)``, squared and in decimals, so a day that equals
    the limit stays out whatever sigma would be rounded to.
    """
    exact, factor = lambda c: F.col(c).cast("decimal(19,0)"), Decimal(str(sigmas))
    days = days.withColumns({"n": F.count("*").over(_by_user()), "sum": F.sum("total").over(_by_user()), "squares": F.sum(exact("total") * exact("total")).over(_by_user())})
    marked = days.withColumns({"mean": F.col("sum") / F.col("n"), "spread": exact("n") * F.col("squares") - exact("sum") * exact("sum"), "above": F.col("n") * F.col("total") - F.col("sum")})
    high = F.when(F.col("spread") == 0, F.col("above") > F.col("sum")).otherwise(exact("above") * F.abs(exact("above")) > F.lit(factor * abs(factor)) * F.col("spread"))
    out = marked.filter(high & (F.col("total") >= least))
    out = out.select(USER, "date", "total", (F.col("total") - F.col("mean")).alias("excess"), (F.col("total") / F.col("mean")).alias("multiplier"))
    return _last(out, last, "date") if last else out


def unusual_weeks(days: DataFrame, factor: float = 1.5, least: int = 5, last: int = 10) -> DataFrame:
    base = days.groupBy(USER).agg((F.sum("late") / F.sum("total")).alias("base"))
    weeks = days.groupBy(USER, F.expr("extract(YEAROFWEEK FROM date)").alias("iso_year"), F.weekofyear("date").alias("iso_week")).agg(F.sum("late").alias("late"), F.sum("total").alias("total"))
    out = weeks.join(base, USER).withColumn("share", F.col("late") / F.col("total")).filter((F.col("share") > factor * F.col("base")) & (F.col("late") >= least))
    return _last(out.select(USER, "iso_year", "iso_week", "late", "total", "share"), last, "iso_year", "iso_week")


def chains(dates: DataFrame, keys: list[str], max_gap: int, least: int, *sums: Column) -> DataFrame:
    """Chains of dates at most ``max_gap`` days apart, of ``least`` dates or more."""
    w = Window.partitionBy(*keys).orderBy("date")
    new = F.coalesce((F.datediff("date", F.lag("date").over(w)) > max_gap).cast("int"), F.lit(0))
    named = dates.withColumn("_new", new).withColumn("_chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = named.groupBy(*keys, "_chain").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("dates"), *sums).filter(F.col("dates") >= least)
    return out.withColumn("span", F.datediff("end", "start") + 1).drop("_chain")


def binge_periods(days: DataFrame, least: int = 10, sigmas: float = 2.0) -> DataFrame:
    out = chains(binge_days(days, least, None, sigmas), [USER], 2, 2, F.sum("total").alias("videos"))
    return out.withColumn("per_day", F.col("videos") / F.col("dates"))


def late_night_moods(days: DataFrame, least: int = 3) -> DataFrame:
    return chains(late_night_days(days, least, None), [USER], 2, 2, F.sum("late").alias("videos"))


def rhythm(rows: DataFrame, weekend_limit: float = 0.35, factor: float = 1.5) -> DataFrame:
    """Weekend share with its flag, and chronotype."""
    hour = F.hour("ts")
    out = rows.filter(F.col("ts").isNotNull()).groupBy(USER).agg(
        F.avg((F.weekday("ts") >= 5).cast("int")).alias("weekend_share"), F.count_if((hour >= 20) | (hour < 5)).alias("night"), F.count_if((hour >= 5) & (hour < 12)).alias("morning")
    )
    kind = F.when(F.col("night") > factor * F.col("morning"), "Night Owl").when(F.col("morning") > factor * F.col("night"), "Early Bird").otherwise("Balanced")
    return out.select(USER, "weekend_share", (F.col("weekend_share") > weekend_limit).alias("weekend_heavy"), "night", "morning", kind.alias("chronotype"))


def inactive_periods(days: DataFrame, least: int = 4, last: int = 5) -> DataFrame:
    before = F.lag("date").over(_by_user().orderBy("date"))
    out = days.select(USER, before.alias("last_active"), F.col("date").alias("resumed")).withColumn("gap_days", F.datediff("resumed", "last_active") - 1).filter(F.col("gap_days") >= least - 1)
    return _last(out, last, "resumed")


def anomalies(days: DataFrame, binge: int = 10, late: int = 3) -> DataFrame:
    """Three of each kind with severity: binge periods, late moods, late days, binge days."""
    take = lambda df, *order: df.withColumn("k", F.row_number().over(_by_user().orderBy(*order))).filter("k <= 3")
    high = lambda test: F.when(test, "high").otherwise("medium")
    parts = (
        take(binge_periods(days, binge), F.desc("span"), "start").select(USER, F.lit(0).alias("t"), "k", F.lit("binge_period").alias("kind"), F.col("start").alias("date"), F.col("span").cast("double").alias("value"), high(F.col("span") >= 5).alias("severity")),
        take(late_night_moods(days, late), F.desc("span"), "start").select(USER, F.lit(1).alias("t"), "k", F.lit("late_mood").alias("kind"), F.col("start").alias("date"), F.col("span").cast("double").alias("value"), high(F.col("span") >= 4).alias("severity")),
        take(late_night_days(days, late, None), F.desc("late"), "date").select(USER, F.lit(2).alias("t"), "k", F.lit("late_day").alias("kind"), "date", F.col("late").cast("double").alias("value"), high(F.col("late") >= 10).alias("severity")),
        take(binge_days(days, binge, None), F.desc("total"), "date").select(USER, F.lit(3).alias("t"), "k", F.lit("binge_day").alias("kind"), "date", F.col("total").cast("double").alias("value"), high(F.col("multiplier") >= 3).alias("severity")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("place", F.row_number().over(_by_user().orderBy("t", "k"))).select(USER, "place", "kind", "date", "value", "severity")


def _dated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and first row of each date of ``keys``; rows without a key or time are left out."""
    known = F.col("ts").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull()
    return rows.filter(known).groupBy(*keys, F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.min("seq").alias("s"))


def _islands(dates: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of consecutive dates: ``start, end, days``, and the sums of their rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    return dates.withColumn("_run", F.date_sub("date", place)).groupBy(*keys, "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), F.sum("n").alias("n"), F.min("s").alias("s"))


def streaks(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Runs of consecutive dates of ``keys``."""
    return _islands(_dated(rows, keys), keys).filter(F.col("days") >= least).select(*keys, "start", "end", "days")


def _summed(dates: DataFrame, keys: list[str], least: int, *aggregates: Column) -> DataFrame:
    """For each of ``keys`` its streaks of ``least`` days and more as an array by start, their number, longest and total, and all dates."""
    held = F.array_sort(F.collect_list(F.when(F.col("days") >= least, F.struct("start", "end", "days"))))
    out = _islands(dates, keys).groupBy(*keys).agg(
        held.alias("habit_streaks"), F.count_if(F.col("days") >= least).alias("streaks"), F.coalesce(F.max(F.when(F.col("days") >= least, F.col("days"))), F.lit(0)).alias("longest"),
        F.coalesce(F.sum(F.when(F.col("days") >= least, F.col("days"))), F.lit(0)).alias("total_days"), F.sum("days").alias("days_watched"), F.sum("n").alias("watches"), F.min("s").alias("s"), *aggregates,
    )
    return out


def longest_streak(rows: DataFrame) -> DataFrame:
    best = streaks(rows, [USER], 1).withColumn("k", F.row_number().over(_by_user().orderBy(F.desc("days"), "start"))).filter("k = 1")
    return best.select(USER, "days", "start", "end", F.concat_ws(" - ", F.date_format("start", "MMM dd"), F.date_format("end", "MMM dd")).alias("label"))


def _habits(rows: DataFrame, key: str, least: int, least_days: int) -> DataFrame:
    out = _summed(_dated(rows, [USER, key]), [USER, key], least).filter((F.col("streaks") > 0) & (F.col("days_watched") >= least_days))
    out = out.withColumn("score", F.least(F.lit(100).cast("long"), F.col("total_days") * 10))
    out = out.withColumn("rank", F.row_number().over(_by_user().orderBy(F.desc("longest"), F.desc("total_days"), "s")))
    return out.select(USER, key, "rank", "days_watched", "streaks", "habit_streaks", "longest", "total_days", "score")


def channel_habits(rows: DataFrame, key: str = "channel_clean", least: int = 3) -> DataFrame:
    """Channels with streaks: the streaks themselves, their number, longest, total days and a score of 10 per day up to 100."""
    return _habits(rows, key, least, 0)


def habit_streaks(habits: DataFrame, key: str = "channel_clean") -> DataFrame:
    """The streaks of habits, one row each."""
    return habits.select(USER, key, F.posexplode("habit_streaks").alias("place", "_s")).select(USER, key, "place", "_s.start", "_s.end", "_s.days")


def _titles(rows: DataFrame, least: int) -> DataFrame:
    title = F.coalesce("text_clean", "text_raw")
    own = rows.withColumn("title", title).filter((F.length("title") > 5) & F.col("ts").isNotNull())
    dates = own.groupBy(USER, "title", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), F.min("seq").alias("s"), F.min_by(F.coalesce("channel_clean", F.lit("Unknown")), "seq").alias("channel"))
    first = dates.groupBy(USER, "title").agg(F.min_by("date", "s").alias("first_seen"), F.min_by("channel", "s").alias("channel"))
    return _summed(dates, [USER, "title"], least).filter("days_watched >= 2").join(first, [USER, "title"])


def rewatched_videos(rows: DataFrame, last: int | None = 30, least: int = 3) -> DataFrame:
    """Titles watched on two dates and more, with their streaks; the first date and channel are those of the first row."""
    out = _titles(rows, least)
    shown = F.when(F.length("title") > 80, F.concat(F.substring("title", 1, 80), F.lit("..."))).otherwise(F.col("title"))
    out = out.withColumn("rank", F.row_number().over(_by_user().orderBy(F.desc("days_watched"), F.desc("watches"), "s")))
    out = out if last is None else out.filter(F.col("rank") <= last)
    return out.select(USER, "rank", shown.alias("title"), "watches", F.col("days_watched").alias("days"), "first_seen", "channel", (F.col("streaks") > 0).alias("has_streak"), F.col("longest").alias("longest_streak"))


def topic_habits(rows: DataFrame, topics: str = "micro_topics", least_days: int = 5, least: int = 3, last: int | None = 30) -> DataFrame:
    """Streaks of topics of ``least_days`` dates and more; rarer topics take no place of the ``last`` best."""
    each = rows.select(USER, "seq", "ts", F.explode(topics).alias("topic"))
    out = _habits(each, "topic", least, least_days)
    return out if last is None else out.filter(F.col("rank") <= last)


def habit_strength(habits: DataFrame) -> DataFrame:
    out = habits.groupBy(USER).agg(F.count("*").alias("n"), F.max("longest").alias("longest"), F.sum(F.when(F.col("rank") <= 5, F.col("total_days")).otherwise(0)).alias("top_days"))
    strength = F.least(F.lit(100).cast("long"), 10 * F.col("n") + 5 * F.col("longest") + F.col("top_days"))
    return out.select(USER, F.col("n").alias("habits"), "longest", strength.alias("strength"))


def habit_report(rows: DataFrame, topics: str | None = None, least: int = 3, least_days: int = 5) -> DataFrame:
    """Per user the strength of channel habits, how many channels, titles and topics recur, and these in words."""
    habits = channel_habits(rows, least=least)
    best = habits.filter("rank = 1").select(USER, F.col("channel_clean").alias("best"))
    number = lambda df, name: df.groupBy(USER).agg(F.count("*").alias(name))
    out = rows.select(USER).distinct().join(habit_strength(habits), USER, "left").join(best, USER, "left").join(number(_titles(rows, least), "videos"), USER, "left")
    out = out.join(number(topic_habits(rows, topics, least_days, least, None), "topics"), USER, "left") if topics else out.withColumn("topics", F.lit(0).cast("long"))
    out = out.fillna(0, ["habits", "longest", "strength", "videos", "topics"])
    text = lambda c: F.col(c).cast("string")
    parts = F.concat_ws(
        " | ",
        F.when(F.col("habits") > 0, F.concat(F.lit("Strongest habit: "), F.col("best"), F.lit(" watched "), text("longest"), F.lit(" days in a row"))),
        F.when(F.col("habits") > 1, F.concat(text("habits"), F.lit(" channels with daily habits"))),
        F.when(F.col("videos") > 0, F.concat(text("videos"), F.lit(" rewatched videos"))),
        F.when(F.col("topics") > 0, F.concat(text("topics"), F.lit(" recurring topics"))),
    )
    words = F.when(parts == "", "No strong habits detected").otherwise(parts)
    return out.select(USER, "habits", "videos", "topics", F.col("longest").alias("max_streak_days"), "strength", words.alias("summary"))
