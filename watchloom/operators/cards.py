"""Year-in-review cards: one DataFrame per card, one row (or a ranked list) per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.clock import with_instants
from watchloom.operators import activity, overlap, sessions, streaks
from watchloom.operators.activity import USER, _counts, ranked


def _by_user():
    return Window.partitionBy(USER)


def stats_overview(watch: DataFrame) -> DataFrame:
    counts = watch.groupBy(USER).agg(F.count("*").alias("watches"), F.count_distinct("channel_clean").alias("channels"), F.count_distinct(F.to_date("ts")).alias("days"))
    return counts.join(sessions.sessionise(watch).groupBy(USER).agg(F.count("*").alias("sessions")), USER, "left").fillna(0, ["sessions"])


def peak_month(watch: DataFrame) -> DataFrame:
    months = watch.filter(F.col("ts").isNotNull()).groupBy(USER, F.date_format("ts", "MMMM").alias("month")).agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return months.groupBy(USER).agg(F.max_by("month", F.struct("n", -F.col("s"))).alias("month"), F.max("n").alias("n"))


def top_channels(watch: DataFrame, n: int = 5) -> DataFrame:
    return activity.top_values(watch, "channel_clean", "channel", n=n).select(USER, "rank", "name", "n", "percent")


def time_spent_card(watch: DataFrame) -> DataFrame:
    """Hours and daily minutes with one decimal, minutes without; halves go to the even digit."""
    t = sessions.time_spent(watch)
    return t.select(USER, F.bround("hours", 1).alias("hours"), F.bround("minutes", 0).alias("minutes"), F.bround("minutes_per_day", 1).alias("daily_minutes"))


def first_seen_peak(watch: DataFrame, slot: Column, name: str, size: int) -> DataFrame:
    """The fullest slot, first seen on ties, its count, and ``slots``, the counts of all ``size`` slots in order."""
    own = watch.filter(F.col("ts").isNotNull()).groupBy(USER, slot.alias(name)).agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    every = F.array(*[F.coalesce(F.sum(F.when(F.col(name) == k, F.col("n"))), F.lit(0)) for k in range(size)])
    return own.groupBy(USER).agg(F.max_by(name, F.struct("n", -F.col("s"))).alias(name), F.max("n").alias("n"), every.alias("slots"))


def watch_cycle(watch: DataFrame) -> DataFrame:
    return first_seen_peak(watch, F.hour("ts"), "hour", 24)


def peak_weekday(watch: DataFrame) -> DataFrame:
    out = first_seen_peak(watch, F.weekday("ts"), "weekday", 7)
    return out.withColumn("day", activity.day_name(F.col("weekday")))


def late_night(watch: DataFrame) -> DataFrame:
    """How many watches lie before 5 AM, and the latest of them: that in the latest hour, of these the last instant."""
    own = with_instants(watch.filter(F.hour("ts") < 5))
    latest = F.max_by("ts", F.struct(F.hour("ts"), F.col("_us")))
    return own.groupBy(USER).agg(F.count("*").alias("n"), latest.alias("latest_ts"), F.date_format(latest, "h:mm a").alias("latest"), F.date_format(latest, "MMMM dd").alias("latest_date"))


def habit_channels(watch: DataFrame, least: int = 4, span: int = 7, gap: float = 14, n: int = 5) -> DataFrame:
    """Channels watched at steady distances; gaps of instants are whole 24-hour days, ``total`` is how many channels there are in all.

    The score is the mean gap less a tenth of the count. Tenths are divided, not multiplied by a binary 0.1, which is a little more than a tenth.
    """
    w = Window.partitionBy(USER, "channel_clean").orderBy("_us", "seq")
    micros = F.col("_us")
    days = lambda c: F.floor(c / 86_400_000_000)
    own = with_instants(watch.filter(F.col("channel_clean").isNotNull() & F.col("ts").isNotNull())).select(USER, "channel_clean", "channel", "seq", micros.alias("m"), days(micros - F.lag(micros).over(w)).alias("gap"))
    out = own.groupBy(USER, "channel_clean").agg(F.count("*").alias("n"), F.min_by("channel", "seq").alias("name"), days(F.max("m") - F.min("m")).alias("span"), F.avg("gap").alias("mean_gap"), F.min("seq").alias("s"))
    out = out.filter((F.col("n") >= least) & (F.col("span") >= span) & (F.col("mean_gap") <= gap)).withColumn("score", F.col("mean_gap") - F.col("n") / 10)
    out = ranked(out, "score", "s").withColumn("total", F.count("*").over(_by_user()))
    return out.filter(F.col("rank") <= n).select(USER, "rank", "name", "n", "span", "mean_gap", "total")


def _slot(hour: Column) -> Column:
    return F.when(hour < 5, "late night").when(hour < 12, "morning").when(hour < 17, "afternoon").when(hour < 21, "evening").otherwise("night")


def patterns(watch: DataFrame, top: int = 20, least_views: int = 10, day: float = 0.30, slot: float = 0.40, lift: float = 1.5, hits: int = 5, weekend_total: int = 10, weekend: float = 0.6, n: int = 5) -> DataFrame:
    """Association rules of channels with weekdays, day times and weekends, ranked by confidence times count.

    A channel needs ``least_views`` or 1 % of all watches, those without a channel or time included. Ties go to the rule
    whose channel and value were seen first. ``total`` is the number of all rules.
    """
    every = watch.groupBy(USER).agg(F.count("*").alias("all"))
    counts = ranked(_counts(watch, "channel_clean"), F.desc("n"), "first_seq").filter(F.col("rank") <= top).join(every, USER)
    kept = counts.filter(F.col("n") >= F.greatest(F.lit(least_views).cast("long"), F.expr("`all` div 100"))).select(USER, "channel_clean")
    rows = watch.filter(F.col("ts").isNotNull()).join(kept, [USER, "channel_clean"])
    # all rules read these counts: at most 24 * 7 rows a channel, ``top`` channels a user
    cells = rows.groupBy(USER, "channel_clean", F.weekday("ts").alias("d"), F.hour("ts").alias("h")).agg(F.count("*").alias("k"), F.min("seq").alias("s"))
    cells = cells.withColumn("c0", F.min("s").over(Window.partitionBy(USER, "channel_clean")))

    def rule(kind: str, k: int, column: Column, least: float) -> DataFrame:
        cell = cells.withColumn("value", column).groupBy(USER, "channel_clean", "c0", "value").agg(F.sum("k").alias("n"), F.min("s").alias("s"))
        whole = cell.withColumns({"c": F.sum("n").over(Window.partitionBy(USER, "channel_clean")), "v": F.sum("n").over(Window.partitionBy(USER, "value")), "t": F.sum("n").over(_by_user())})
        scored = whole.withColumns({"confidence": F.col("n") / F.col("c"), "lift": F.col("n") * F.col("t") / (F.col("c") * F.col("v"))})
        scored = scored.filter((F.col("confidence") >= least) & (F.col("lift") >= lift) & (F.col("n") >= hits))
        return scored.select(USER, F.lit(kind).alias("kind"), F.lit(k).alias("k"), "channel_clean", "value", "confidence", "n", "c0", "s")

    late = F.col("d") >= 5
    ends = cells.groupBy(USER, "channel_clean").agg(F.sum("k").alias("n"), (F.sum(F.when(late, F.col("k")).otherwise(0)) / F.sum("k")).alias("confidence"), F.min(F.when(late, F.col("s"))).alias("s"))
    ends = ends.filter((F.col("n") >= weekend_total) & (F.col("confidence") >= weekend))
    best = ends.withColumn("r", F.row_number().over(_by_user().orderBy(F.desc("n"), "s"))).filter("r = 1")
    best = best.select(USER, F.lit("weekend").alias("kind"), F.lit(2).alias("k"), "channel_clean", F.lit("weekend").alias("value"), "confidence", "n", F.col("s").alias("c0"), "s")
    found = rule("weekday", 0, activity.day_name(F.col("d")), day).unionByName(rule("slot", 1, _slot(F.col("h")), slot)).unionByName(best)
    out = ranked(found, F.desc(F.col("confidence") * F.col("n")), "k", "c0", "s").withColumn("total", F.count("*").over(_by_user())).filter(F.col("rank") <= n)
    share = F.concat(F.floor(F.col("confidence") * 100).cast("string"), F.lit("%"))
    words = (
        F.when(F.col("k") == 0, F.concat(F.lit("You watch **"), F.col("channel_clean"), F.lit("** on **"), F.col("value"), F.lit("s** ("), share, F.lit(" of the time)")))
        .when(F.col("k") == 1, F.concat(F.lit("**"), F.col("channel_clean"), F.lit("** is your **"), F.col("value"), F.lit("** go-to ("), share, F.lit(")")))
        .otherwise(F.concat(F.lit("**"), F.col("channel_clean"), F.lit("** is your **weekend** channel ("), share, F.lit(" weekend views)")))
    )
    return out.select(USER, "rank", "kind", "channel_clean", "value", "confidence", "n", "total", words.alias("insight"))


def rewatched(watch: DataFrame) -> DataFrame:
    titles = _counts(watch, "text_clean").filter("n > 1")
    return titles.groupBy(USER).agg(F.count("*").alias("titles"), F.substring(F.max_by("text_clean", F.struct("n", -F.col("first_seq"))), 1, 100).alias("top"), F.max("n").alias("times"))


def searches(events: DataFrame, n: int = 5) -> DataFrame:
    """Total and top terms; users without any term have no row."""
    return activity.search_analytics(events, n).select(USER, "rank", "term", "n", "searches")


def first_and_last(watch: DataFrame) -> DataFrame:
    """By instants, the smaller ``seq`` first; dates are wall-clock ones."""
    own = with_instants(watch.filter(F.col("ts").isNotNull())).withColumn("title", F.substring(F.coalesce("text_clean", F.lit("Unknown")), 1, 80))
    first, last = F.struct("_us", "seq"), F.struct("_us", "seq")
    long = lambda c: F.date_format(c, "MMMM dd, yyyy")
    out = own.groupBy(USER).agg(F.min_by("title", first).alias("first_title"), F.min_by("ts", first).alias("first_ts"), F.max_by("title", last).alias("last_title"), F.max_by("ts", last).alias("last_ts"))
    return out.withColumns({"first_date": long("first_ts"), "last_date": long("last_ts")})


def card_document(events: DataFrame, year: int, version: str = "1.0") -> DataFrame:
    """All cards of a user with watches as one JSON document, with its year, version and totals; lists are in the order of their ranks.

    The cards are rows of name and text that meet in one shuffle by user, so there is no join for each card.
    """
    watch = activity.watches(events)
    body = lambda df: F.struct(*[c for c in df.columns if c != USER])
    lists = lambda df: df.groupBy(USER).agg(F.to_json(F.sort_array(F.collect_list(body(df)))).alias("card"))
    one = lambda df: df.select(USER, F.to_json(body(df)).alias("card"))
    top = top_channels(watch)
    totals = events.groupBy(USER).agg(F.count("*").alias("total_events"), F.count_if(F.col("type") == "watch").alias("total_watch")).filter(F.col("total_watch") > 0)
    cards = {
        "stats": one(stats_overview(watch)), "time": one(time_spent_card(watch)), "peak_month": one(peak_month(watch)), "top_channel": one(top.filter(F.col("rank") == 1)), "top_channels": lists(top),
        "watch_cycle": one(watch_cycle(watch)), "peak_weekday": one(peak_weekday(watch)),
        "streak": one(streaks.longest_streak(watch)), "binge": one(sessions.binge_sessions(watch)), "late_night": one(late_night(watch)), "habits": lists(habit_channels(watch)),
        "patterns": lists(patterns(watch)), "rewatched": one(rewatched(watch)), "subscriptions": one(overlap.subscription_overlap(events)), "searches": lists(searches(events)), "first_last": one(first_and_last(watch)),
        "metadata": one(totals.select(USER, F.lit(version).alias("version"), "total_events", "total_watch")),
    }
    rows = None
    for k, (name, df) in enumerate(cards.items()):
        row = df.select(USER, F.lit(k).alias("k"), F.concat(F.lit(f'"{name}":'), "card").alias("part"))
        rows = row if rows is None else rows.unionByName(row)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])
    whole = F.concat(F.lit(f'{{"year":{int(year)},'), F.array_join(parts, ","), F.lit("}"))
    # only users with watches have metadata
    return rows.groupBy(USER).agg(whole.alias("cards"), F.max("k").alias("_k")).filter(F.col("_k") == len(cards) - 1).select(USER, "cards")
