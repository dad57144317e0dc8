"""The full report: all DataFrames of one user table, over one canonical parent, as rows and as one document per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.operators import activity, overlap, sessions, streaks
from watchloom.operators.activity import USER


def full_report(events: DataFrame) -> dict[str, DataFrame]:
    """Ten sections and their parts as ``section.part``, lazily defined over ``events``; persist it first if several are to be computed.

    ``habit_formation.topics`` is there if events have ``micro_topics``.
    """
    watch = activity.watches(events)
    days, months, habits = streaks.daily(watch), activity.monthly_stats(watch), streaks.channel_habits(watch)
    report = {
        "summary.totals": activity.summary(events),
        "channels.top": activity.top_values(watch, "channel_clean", "channel"), "channels.engagement": activity.engagement_summary(events), "channels.buckets": activity.view_count_buckets(watch),
        "watch_patterns.hours": activity.hour_histogram(watch), "watch_patterns.weekdays": activity.weekday_histogram(watch), "watch_patterns.peaks": activity.peaks(watch), "watch_patterns.intervals": activity.time_intervals(watch),
        "watch_patterns.weeks": activity.weekly_peak_day(watch), "watch_patterns.best_day": activity.overall_peak_day(watch),
        "searches.top": activity.search_analytics(events),
        "subscription_overlap.counts": overlap.subscription_overlap(events), "subscription_overlap.names": overlap.overlap_names(events),
        "behavior_anomalies.list": streaks.anomalies(days), "behavior_anomalies.baseline": streaks.baseline(days), "behavior_anomalies.late_nights": streaks.late_night_days(days), "behavior_anomalies.binge_days": streaks.binge_days(days),
        "behavior_anomalies.unusual_weeks": streaks.unusual_weeks(days), "behavior_anomalies.moods": streaks.late_night_moods(days), "behavior_anomalies.rhythm": streaks.rhythm(watch),
        "habit_formation.channels": habits.drop("habit_streaks"), "habit_formation.videos": streaks.rewatched_videos(watch), "habit_formation.strength": streaks.habit_strength(habits),
        "temporal_trends.months": months, "temporal_trends.shifts": activity.pattern_shifts(months), "temporal_trends.summary": activity.trend_summary(months),
        "time_spent.totals": sessions.time_spent(watch),
        "channel_distribution.buckets": activity.view_count_buckets(watch), "channel_distribution.months": activity.month_by_bin(watch), "channel_distribution.stats": activity.distribution_stats(watch),
    }
    if "micro_topics" in events.columns:
        report["habit_formation.topics"] = streaks.topic_habits(watch).drop("habit_streaks")
    return report


#: What tells the rows of a part apart within a user, in their order.
ORDER = {
    "channels.top": ("rank",), "channels.buckets": ("bucket",), "watch_patterns.hours": ("hour",), "watch_patterns.weekdays": ("weekday",), "watch_patterns.intervals": ("interval",), "watch_patterns.weeks": ("iso_year", "iso_week"),
    "searches.top": ("rank",), "subscription_overlap.names": ("kind", "rank"), "behavior_anomalies.list": ("place",), "behavior_anomalies.late_nights": ("date",), "behavior_anomalies.binge_days": ("date",),
    "behavior_anomalies.unusual_weeks": ("iso_year", "iso_week"), "behavior_anomalies.moods": ("start",), "habit_formation.channels": ("channel_clean",), "habit_formation.videos": ("title",), "habit_formation.topics": ("topic",),
    "temporal_trends.months": ("month",), "temporal_trends.shifts": ("rank",), "channel_distribution.buckets": ("bucket",), "channel_distribution.months": ("month", "bucket"),
}
#: Fractions are told in whole parts of this.
PARTS_OF_ONE = 1_000


def told(c: str, kind: str) -> Column:
    """A value as text: fractions in thousandths, all else as it is."""
    return F.round(F.col(c) * PARTS_OF_ONE).cast("long").cast("string") if kind in ("double", "float") else F.col(c).cast("string")


def report_rows(report: dict[str, DataFrame], keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``user_id, part, place, field, value``: each value of each row of each part; ``place`` is the row's key in words, nulls are left out."""
    out = None
    for part, df in report.items():
        key = (keys or ORDER).get(part, ())
        place = F.concat_ws("|", *[told(k, dict(df.dtypes)[k]) for k in key]) if key else F.lit("")
        fields = F.array(*[F.struct(F.lit(c).alias("field"), told(c, kind).alias("value")) for c, kind in df.dtypes if c != USER and c not in key])
        rows = df.select(USER, F.lit(part).alias("part"), place.alias("place"), F.inline(fields)).filter(F.col("value").isNotNull())
        out = rows if out is None else out.unionByName(rows)
    return out


def report_documents(report: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per user: for each part its rows in order. All parts meet in one shuffle by user."""
    rows = None
    for part, df in report.items():
        key = ORDER.get(part, ())
        order = F.struct(*[F.col(k) for k in key]) if key else F.lit(0)
        body = F.to_json(F.struct(*[c for c in df.columns if c != USER]))
        own = df.select(USER, F.lit(part).alias("part"), F.row_number().over(Window.partitionBy(USER).orderBy(order)).alias("place"), body.alias("body"))
        rows = own if rows is None else rows.unionByName(own)
    lists = rows.groupBy(USER, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]).alias("rows"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "rows"))), lambda p: F.concat(F.lit('"'), p["part"], F.lit('":['), F.array_join(p["rows"], ","), F.lit("]")))
    return lists.groupBy(USER).agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("report"))

