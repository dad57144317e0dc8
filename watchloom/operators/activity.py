"""Per-user counts, tops and histograms over canonical events.

Events have ``user_id, seq, type, engagement, ts, channel, channel_clean, text_raw, text_clean``; ``ts`` is the
effective local time. Every window is partitioned by user. Ties of tops go to the value seen first (least
``seq``), ties of dense histograms to the lowest slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = "user_id"
# View-count buckets and day names.
BUCKETS = ((1, 1, "1"), (2, 5, "2-5"), (6, 10, "6-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 100, "51-100"), (101, None, "100+"))
INTERVALS = ("Night (12AM-6AM)", "Morning (6AM-12PM)", "Afternoon (12PM-6PM)", "Evening (6PM-12AM)")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
LANGUAGES = ("english", "hindi", "hinglish", "unknown")


def hour_label(hour: Column) -> Column:
    """``12 AM`` to ``11 PM``."""
    return F.concat(((hour + 11) % 12 + 1).cast("string"), F.when(hour < 12, " AM").otherwise(" PM"))


def day_name(weekday: Column) -> Column:
    """Name of a weekday counted from Monday, 0."""
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), weekday + 1)


def language_counts(where: Column | None = None) -> list[Column]:
    """How many rows have each of the four languages; rows without one count nowhere."""
    test = lambda x: F.col("language_type") == x
    return [F.count_if(test(x) if where is None else where & test(x)).alias(x) for x in LANGUAGES]


def watches(events: DataFrame, engagement: str | None = None) -> DataFrame:
    own = events.filter(F.col("type") == "watch")
    return own.filter(F.col("engagement") == engagement) if engagement else own


def summary(events: DataFrame) -> DataFrame:
    """Totals, distinct watched channels, first and last time; with a column ``language_type`` also language counts of all events."""
    kind = lambda t: F.count_if(F.col("type") == t)
    languages = language_counts() if "language_type" in events.columns else []
    return events.groupBy(USER).agg(
        kind("watch").alias("watches"), kind("search").alias("searches"), kind("subscribe").alias("subscriptions"), F.count("*").alias("events"),
        F.count_distinct(F.when(F.col("type") == "watch", F.col("channel_clean"))).alias("channels"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), *languages,
    )


def _counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(F.col(key).isNotNull()).groupBy(USER, key).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def ranked(counts: DataFrame, *order: Column, by: tuple[str, ...] = (USER,)) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_values(rows: DataFrame, key: str, display: str, names: DataFrame | None = None, n: int = 20) -> DataFrame:
    """The n most frequent values with count, share of all counted rows, display name and what is left over."""
    counts = _counts(rows, key).withColumn("total", F.sum("n").over(Window.partitionBy(USER)))
    top = ranked(counts, F.desc("n"), "first_seq").filter(F.col("rank") <= n)
    shown = (names if names is not None else rows).filter(F.col(key).isNotNull() & F.col(display).isNotNull()).groupBy(USER, key).agg(F.min_by(display, "seq").alias("name"))
    top = top.join(shown, [USER, key], "left")
    other = F.col("total") - F.sum("n").over(Window.partitionBy(USER))
    return top.select(USER, "rank", key, "name", "n", (F.col("n") * 100 / F.col("total")).alias("percent"), other.alias("other"))


def bucket(n: Column) -> Column:
    out = None
    for low, high, name in BUCKETS:
        test = n >= low if high is None else (n >= low) & (n <= high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _dense(cells: DataFrame, keys: tuple[str, ...], slot: str, slots: tuple, **sums: str) -> DataFrame:
    """One row for each of ``slots`` per group of ``keys``, zero-filled, in one aggregation: the slots are few and known."""
    each = [F.struct(F.lit(x).alias(slot), *[F.coalesce(F.sum(F.when(F.col(slot) == x, F.col(c))), F.lit(0)).alias(out) for out, c in sums.items()]) for x in slots]
    wide = cells.groupBy(*keys).agg(F.array(*each).alias("_slots"))
    return wide.select(*keys, F.explode("_slots").alias("_s")).select(*keys, "_s.*")


_BUCKET_NAMES = tuple(b[2] for b in BUCKETS)


def view_count_buckets(rows: DataFrame) -> DataFrame:
    """Channels and their watches by the channel's number of watches; a user without any channel has zeros."""
    counts = rows.groupBy(USER, "channel_clean").agg(F.count("*").alias("n"))
    cells = counts.withColumns({"bucket": F.when(F.col("channel_clean").isNotNull(), bucket(F.col("n"))), "one": F.lit(1).cast("long")})
    return _dense(cells, (USER,), "bucket", _BUCKET_NAMES, channels="one", videos="n")


def distribution_stats(rows: DataFrame) -> DataFrame:
    one = F.count_if(F.col("n") == 1)
    return _counts(rows, "channel_clean").groupBy(USER).agg(F.count("*").alias("channels"), F.sum("n").alias("videos"), one.alias("single"), (one * 100 / F.count("*")).alias("single_percent"))


def engagement_summary(events: DataFrame) -> DataFrame:
    own = lambda e: F.count_if((F.col("type") == "watch") & (F.col("engagement") == e))
    return events.groupBy(USER).agg(own("active").alias("active"), own("passive").alias("passive"), F.count_if(F.col("type") == "watch").alias("watches"))


def histogram(rows: DataFrame, slot: Column, size: int, name: str) -> DataFrame:
    """Zero-filled counts with percent of the user's total and share of the largest slot."""
    counts = rows.select(USER, slot.cast("int").alias(name)).groupBy(USER, name).agg(F.count("*").alias("k"))
    full = _dense(counts, (USER,), name, tuple(range(size)), n="k")
    user = Window.partitionBy(USER)
    return full.select(USER, name, "n", (F.col("n") * 100 / F.nullif(F.sum("n").over(user), F.lit(0))).alias("percent"), (F.col("n") / F.nullif(F.max("n").over(user), F.lit(0))).alias("of_max"))


def hour_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, F.hour("ts"), 24, "hour").withColumn("label", hour_label(F.col("hour")))


def weekday_histogram(rows: DataFrame) -> DataFrame:
    return histogram(rows, F.weekday("ts"), 7, "weekday").withColumn("label", day_name(F.col("weekday")))


def peaks(rows: DataFrame) -> DataFrame:
    """Peak hour and weekday with their counts, the lowest one on ties; 0 where no row has a time."""
    cells = rows.groupBy(USER, F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(F.count("*").alias("k"))
    best = lambda name, size: F.array_max(F.array(*[F.struct(F.coalesce(F.sum(F.when(F.col(name) == x, F.col("k"))), F.lit(0)).alias("n"), F.lit(-x).alias("slot")) for x in range(size)]))
    out = cells.groupBy(USER).agg(best("hour", 24).alias("h"), best("weekday", 7).alias("d"))
    hour, day = -F.col("h.slot"), -F.col("d.slot")
    return out.select(USER, hour.alias("peak_hour"), F.col("h.n").alias("peak_hour_count"), day.alias("peak_weekday"), day_name(day).alias("peak_day"), F.col("d.n").alias("peak_weekday_count"))


def time_intervals(rows: DataFrame) -> DataFrame:
    """Watches by quarter of the day; ``peak`` marks the user's fullest one, the earliest on ties."""
    out = histogram(rows, F.floor(F.hour("ts") / 6), 4, "slot")
    first = F.row_number().over(Window.partitionBy(USER).orderBy(F.desc("n"), "slot")) == 1
    hours = F.concat((F.col("slot") * 6).cast("string"), F.lit("-"), (F.col("slot") * 6 + 6).cast("string"))
    return out.select(USER, F.element_at(F.array(*[F.lit(x) for x in INTERVALS]), F.col("slot") + 1).alias("interval"), hours.alias("hours"), "n", "percent", first.alias("peak"))


def weekly_peak_day(rows: DataFrame, last: int = 12) -> DataFrame:
    """Per ISO week the weekday with most watches (first seen on ties), of the last weeks."""
    timed = rows.filter(F.col("ts").isNotNull()).select(USER, "seq", F.expr("extract(YEAROFWEEK FROM ts)").alias("iso_year"), F.weekofyear("ts").alias("iso_week"), F.weekday("ts").alias("weekday"))
    days = timed.groupBy(USER, "iso_year", "iso_week", "weekday").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    weeks = days.groupBy(USER, "iso_year", "iso_week").agg(F.max_by("weekday", F.struct("n", -F.col("s"))).alias("weekday"), F.max("n").alias("n"))
    out = ranked(weeks, F.desc("iso_year"), F.desc("iso_week")).filter(F.col("rank") <= last)
    return out.select(USER, "iso_year", "iso_week", "weekday", "n")


def overall_peak_day(rows: DataFrame) -> DataFrame:
    """The weekday that wins most weeks; ties go to the winner of the earliest week."""
    weeks = weekly_peak_day(rows, 1 << 30)
    wins = weeks.groupBy(USER, "weekday").agg(F.count("*").alias("wins"), F.min(F.col("iso_year") * 100 + F.col("iso_week")).alias("w"))
    return wins.groupBy(USER).agg(F.max_by("weekday", F.struct("wins", -F.col("w"))).alias("weekday"), F.max("wins").alias("wins"), F.sum("wins").alias("weeks"))


def monthly_stats(rows: DataFrame) -> DataFrame:
    """Per month watches, peak hour and peak weekday (first seen on ties) with counts and labels.

    Rows are counted once by month, hour and weekday; all else comes from these counts.
    """
    timed = rows.filter(F.col("ts").isNotNull()).select(USER, "seq", F.trunc("ts", "MM").alias("first_day"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
    cells = timed.groupBy(USER, "first_day", "hour", "weekday").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    out = None
    for slot in ("hour", "weekday"):
        own = cells.groupBy(USER, "first_day", slot).agg(F.sum("n").alias("n"), F.min("s").alias("s"))
        best = F.max_by(F.struct(F.col(slot).alias("slot"), "n"), F.struct("n", -F.col("s")))
        part = own.groupBy(USER, "first_day").agg(*([F.sum("n").alias("watches")] if out is None else []), best.alias(slot))
        out = part if out is None else out.join(part, [USER, "first_day"])
    hour, day = F.col("hour.slot"), F.col("weekday.slot")
    return out.select(
        USER, F.date_format("first_day", "yyyy-MM").alias("month"), F.date_format("first_day", "MMM yyyy").alias("month_label"), "watches", hour.alias("peak_hour"), hour_label(hour).alias("peak_hour_label"),
        F.col("hour.n").alias("peak_hour_count"), day.alias("peak_weekday"), day_name(day).alias("peak_day"), F.col("weekday.n").alias("peak_weekday_count"),
    )


def monthly_trends(months: DataFrame) -> DataFrame:
    """The three projections of the monthly report as rows: ``trend`` hour, day or activity, its value and how it reads."""
    trends = F.array(
        F.struct(F.lit("hour").alias("trend"), F.col("peak_hour").cast("long").alias("value"), F.col("peak_hour_label").alias("label")),
        F.struct(F.lit("day").alias("trend"), F.col("peak_weekday").cast("long").alias("value"), F.col("peak_day").alias("label")),
        F.struct(F.lit("activity").alias("trend"), F.col("watches").alias("value"), F.col("watches").cast("string").alias("label")),
    )
    return months.select(USER, "month", "month_label", F.explode(trends).alias("t")).select(USER, "month", "month_label", "t.*")


def pattern_shifts(months: DataFrame, hours: int = 4, first: int | None = 10) -> DataFrame:
    """Between listed neighbour months: peak hour moved by ``hours`` or more, or peak day crossed the weekend."""
    w = Window.partitionBy(USER).orderBy("month")
    before = months.withColumn("b", F.lag(F.struct("month_label", "peak_hour", "peak_hour_label", "peak_weekday", "peak_day")).over(w)).filter(F.col("b").isNotNull())
    end = lambda day: F.when(day >= 5, "weekend").otherwise("weekday")
    old, new = end(F.col("b.peak_weekday")), end(F.col("peak_weekday"))
    moved = F.when(
        F.abs(F.col("peak_hour") - F.col("b.peak_hour")) >= hours,
        F.struct(F.lit(0).alias("k"), F.lit("peak_hour").alias("kind"), F.col("b.peak_hour_label").alias("old"), F.col("peak_hour_label").alias("new"), F.concat(F.lit("Peak hour shifted from "), F.col("b.peak_hour_label"), F.lit(" to "), F.col("peak_hour_label")).alias("description")),
    )
    crossed = F.when(
        old != new,
        F.struct(F.lit(1).alias("k"), F.lit("peak_day").alias("kind"), F.col("b.peak_day").alias("old"), F.col("peak_day").alias("new"), F.concat(F.lit("Shifted from "), old, F.lit(" to "), new).alias("description")),
    )
    each = before.select(USER, "month", F.col("b.month_label").alias("from_month"), F.col("month_label").alias("to_month"), F.explode(F.array_compact(F.array(moved, crossed))).alias("x"))
    out = ranked(each.select(USER, "month", "from_month", "to_month", "x.*"), "month", "k")
    out = out if first is None else out.filter(F.col("rank") <= first)
    return out.select(USER, "rank", "from_month", "to_month", "kind", "old", "new", "description")


def trend_summary(months: DataFrame) -> DataFrame:
    """Months tracked, shifts found, and both in words."""
    shifts = pattern_shifts(months, first=None).groupBy(USER).agg(F.count("*").alias("shifts"))
    span = months.groupBy(USER).agg(F.count("*").alias("months"), F.min_by("month_label", "month").alias("a"), F.max_by("month_label", "month").alias("b"))
    out = span.join(shifts, USER, "left").fillna(0, ["shifts"])
    words = F.concat(F.lit("Tracked "), F.col("months").cast("string"), F.lit(" months from "), F.col("a"), F.lit(" to "), F.col("b"))
    found = F.when(F.col("shifts") > 0, F.concat(F.lit(" | "), F.col("shifts").cast("string"), F.lit(" significant pattern shifts detected"))).otherwise("")
    return out.select(USER, "months", "shifts", F.concat(words, found).alias("summary"))


def month_by_bin(rows: DataFrame) -> DataFrame:
    """Watches per month by the channel's all-time bin, zero-filled, with the share of the month.

    Rows are counted once by channel and month; a channel's bin is the sum of its months.
    """
    own = rows.filter(F.col("channel_clean").isNotNull() & F.col("ts").isNotNull())
    cells = own.groupBy(USER, "channel_clean", F.trunc("ts", "MM").alias("first_day")).agg(F.count("*").alias("k"))
    named = cells.withColumn("bucket", bucket(F.sum("k").over(Window.partitionBy(USER, "channel_clean"))))
    full = _dense(named, (USER, "first_day"), "bucket", _BUCKET_NAMES, n="k")
    share = F.col("n") / F.sum("n").over(Window.partitionBy(USER, "first_day"))
    return full.select(USER, F.date_format("first_day", "yyyy-MM").alias("month"), "bucket", "n", share.alias("share"))


def share_of_max(rows: DataFrame, value: str, by: tuple[str, ...] = (USER,)) -> DataFrame:
    """``rows`` with ``share_of_max``, the length of a bar: the value by the largest of its group, null where that is zero."""
    return rows.withColumn("share_of_max", F.col(value) / F.nullif(F.max(value).over(Window.partitionBy(*by)), F.lit(0)))


def last_months(rows: DataFrame, n: int = 12) -> DataFrame:
    """Rows of a user's last ``n`` months that are there."""
    return rows.withColumn("_m", F.dense_rank().over(Window.partitionBy(USER).orderBy(F.desc("month")))).filter(F.col("_m") <= n).drop("_m")


def search_analytics(events: DataFrame, n: int = 20) -> DataFrame:
    """Top terms with the first raw spelling, totals, and language counts where there is a column ``language_type``."""
    own = events.filter(F.col("type") == "search")
    top = top_values(own, "text_clean", "text_raw", n=n)
    languages = language_counts() if "language_type" in events.columns else []
    totals = own.groupBy(USER).agg(F.count("*").alias("searches"), F.count_distinct("text_clean").alias("terms"), *languages)
    names = LANGUAGES if languages else ()
    return top.join(totals, USER).select(USER, "rank", F.col("text_clean").alias("term"), F.coalesce("name", "text_clean").alias("spelling"), "n", "searches", "terms", *names)
