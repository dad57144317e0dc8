"""Sketches of a user's days, merged over any range: distinct channels, quantiles and top channels, with the exact way beside them.

A day's row holds three sketches of bounded size, so a range of days is answered from days instead of events, and days can be added later.

Documented bounds: distinct counts (HyperLogLog, 2**12 registers) have a relative standard error of 1.04 / sqrt(2**12), 1.6 %; three times that is
taken as the bound. Quantiles (KLL, k = 200) have a rank error of at most 1.65 %. Tops (frequent items) are off by at most 3.5 / (0.75 * items)
of all rows where ``items`` is the size of the map, and not at all while a user has no more than three quarters of that many values.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USER = "user_id"
REGISTERS, KLL, ITEMS = 12, 200, 1024
DISTINCT_BOUND, RANK_BOUND = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0165


def daily_sketches(watch: DataFrame, value: str = "minute", registers: int = REGISTERS, k: int = KLL, items: int = ITEMS) -> DataFrame:
    """``user_id, date, n, distinct, quantiles, top`` of watches with a channel and a time; ``value`` is the whole number whose quantiles are kept, else the minute of the day."""
    number = F.col(value).cast("long") if value in watch.columns else (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    rows = watch.filter(F.col("channel_clean").isNotNull() & F.col("ts").isNotNull()).select(USER, F.to_date("ts").alias("date"), "channel_clean", number.alias("number"))
    return rows.groupBy(USER, "date").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("channel_clean", registers).alias("distinct"), F.kll_sketch_agg_bigint("number", k).alias("quantiles"), F.expr(f"approx_top_k_accumulate(channel_clean, {items})").alias("top")
    )


def merged(days: DataFrame, start: dt.date | None = None, end: dt.date | None = None, items: int = ITEMS) -> DataFrame:
    """One row of sketches for each user over the days from ``start`` to ``end``, both included."""
    own = days
    if start is not None:
        own = own.filter(F.col("date") >= F.lit(start))
    if end is not None:
        own = own.filter(F.col("date") <= F.lit(end))
    return own.groupBy(USER).agg(
        F.sum("n").alias("n"), F.count("*").alias("days"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_bigint("quantiles").alias("quantiles"), F.expr(f"approx_top_k_combine(top, {items})").alias("top")
    )


def estimates(sketches: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75), n: int = 5) -> DataFrame:
    """``user_id, n, days, channels, quantiles, top`` read from merged sketches; ``top`` lists ``(item, count)``."""
    at = F.array(*[F.kll_sketch_get_quantile_bigint("quantiles", F.lit(r)) for r in ranks])
    return sketches.select(USER, "n", "days", F.hll_sketch_estimate("distinct").alias("channels"), at.alias("quantiles"), F.expr(f"approx_top_k_estimate(top, {n})").alias("top"))


def exact(watch: DataFrame, start: dt.date | None = None, end: dt.date | None = None, value: str = "minute", n: int = 5) -> DataFrame:
    """The same from events: ``user_id, n, days, channels, values`` (all numbers in order) and ``top``; for checks and small ranges."""
    number = F.col(value).cast("long") if value in watch.columns else (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    rows = watch.filter(F.col("channel_clean").isNotNull() & F.col("ts").isNotNull()).select(USER, F.to_date("ts").alias("date"), "channel_clean", number.alias("number"))
    if start is not None:
        rows = rows.filter(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.lit(end))
    whole = rows.groupBy(USER).agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"), F.count_distinct("channel_clean").alias("channels"), F.array_sort(F.collect_list("number")).alias("values"))
    counts = rows.groupBy(USER, "channel_clean").agg(F.count("*").alias("count"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy(USER).orderBy(F.desc("count"), "channel_clean"))).filter(F.col("r") <= n)
    return whole.join(best.groupBy(USER).agg(F.array_sort(F.collect_list("count")).alias("top")), USER)


def within_bounds(found: DataFrame, true: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75), items: int = ITEMS) -> DataFrame:
    """``user_id, n_ok, channels_ok, quantiles_ok, top_ok``: whether each estimate is within its documented bound of the exact result."""
    both = found.select(USER, "n", "days", "channels", "quantiles", F.array_sort(F.transform("top", lambda t: t["count"])).alias("top")).join(
        true.select(USER, F.col("n").alias("m"), F.col("days").alias("d"), F.col("channels").alias("c"), "values", F.col("top").alias("t")), USER
    )
    # the ranks that a value has: the share of numbers below it up to the share of those not above it
    share = lambda test: F.size(F.filter("values", test)) / F.col("m")

    def good(q: Column, r: float) -> Column:
        return (share(lambda v: v < q) <= r + RANK_BOUND) & (share(lambda v: v <= q) >= r - RANK_BOUND)

    rank_ok = functools.reduce(Column.__and__, [good(F.col("quantiles")[k], r) for k, r in enumerate(ranks)])
    slack = F.when(F.col("c") > 0.75 * items, F.col("m") * 3.5 / (0.75 * items)).otherwise(0)
    top_ok = (F.size("top") == F.size("t")) & ~F.exists(F.zip_with("top", "t", lambda a, b: F.abs(a - b) > slack), lambda x: x)
    return both.select(USER, ((F.col("n") == F.col("m")) & (F.col("days") == F.col("d"))).alias("n_ok"), (F.abs(F.col("channels") / F.col("c") - 1) <= DISTINCT_BOUND).alias("channels_ok"), rank_ok.alias("quantiles_ok"), top_ok.alias("top_ok"))
