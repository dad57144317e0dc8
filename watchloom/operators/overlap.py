"""Set operations of subscribed and watched channels, and the channel table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USER = "user_id"


def _channels(events: DataFrame) -> DataFrame:
    """One row for each user and channel: whether it is subscribed to (``s``), watched (``w``), and its last name, in one pass and one shuffle."""
    order = F.struct(F.when(F.col("type") == "watch", 0).when(F.col("type") == "search", 1).otherwise(2), "seq")
    own = events.filter(F.col("channel_clean").isNotNull())
    return own.groupBy(USER, "channel_clean").agg(F.bool_or(F.col("type") == "subscribe").alias("s"), F.bool_or(F.col("type") == "watch").alias("w"), F.max_by("channel", order).alias("name"))


def subscription_overlap(events: DataFrame) -> DataFrame:
    """Counts of both, ghost (subscribed only) and unsubscribed channels."""
    s, w = F.col("s"), F.col("w")
    found = _channels(events).filter(s | w)
    out = found.groupBy(USER).agg(F.count_if(s).alias("subscribed"), F.count_if(w).alias("watched"), F.count_if(s & w).alias("both"), F.count_if(s & ~w).alias("ghost"), F.count_if(w & ~s).alias("unsubscribed"))
    return out.withColumn("percent", F.col("both") * 100 / F.nullif("subscribed", F.lit(0)))


def overlap_names(events: DataFrame, n: int = 20) -> DataFrame:
    """Up to n names of each kind, ordered by channel; the display name is the last seen."""
    kind = F.when(F.col("s") & F.col("w"), "both").when(F.col("s"), "ghost").when(F.col("w"), "unsubscribed")
    by = Window.partitionBy(USER, "kind").orderBy("channel_clean")
    ranked = _channels(events).withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("rank", F.row_number().over(by))
    return ranked.filter(F.col("rank") <= n).select(USER, "kind", "rank", "channel_clean", "name")


def unknown_channels(counts: DataFrame, known: DataFrame, key: str, least: int = 2, size: int = 50) -> DataFrame:
    """Channels with ``least`` watches and more that the table lacks, in batches of ``size``; only the last batch is smaller.

    Places are running numbers by hash group and key: a rank inside each of 4096 groups after the sizes of the
    groups before it, so no task sees more than a group.
    """
    missing = counts.filter(F.col("n") >= least).join(known.select(key), key, "left_anti").withColumn("_g", F.substring(F.md5(key), 1, 3))
    sizes = missing.groupBy("_g").agg(F.count("*").alias("_n"))  # at most 4096 rows
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_g", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy(key)) - 1
    return missing.join(F.broadcast(offsets), "_g").withColumn("place", place).select(key, "n", "place", F.floor(F.col("place") / size).alias("batch"))


def requests(batches: DataFrame, key: str) -> DataFrame:
    """One row per batch with its channels in order."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("place", key))), lambda s: s[key])
    return batches.groupBy("batch").agg(keys.alias("keys"))


def stale(known: DataFrame, now, days: int = 30) -> DataFrame:
    """Known channels fetched more than ``days`` days ago, due for a refresh."""
    return known.filter(F.col("fetched") < F.lit(now) - F.expr(f"interval {days} days"))


def upsert(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key; ``fetch_count`` goes up by one for each new row."""
    own = [c for c in known.columns if c not in (key, "fetch_count")]
    old = known.select(key, F.col("fetch_count").alias("_n"), *[F.col(c).alias(f"_{c}") for c in own])
    fresh = F.col("_new").isNotNull()
    joined = old.join(new.select(key, *own).withColumn("_new", F.lit(True)), key, "full_outer")
    return joined.select(key, *[F.when(fresh, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in own], (F.coalesce("_n", F.lit(0)) + fresh.cast("long")).alias("fetch_count"))


def categories(channels: DataFrame, key: str, topics: str, mapping: DataFrame, fallback: DataFrame, name: str = "name") -> DataFrame:
    """Distinct categories of a channel's topics in order, the first as primary; else that of the first fallback keyword in the name.

    ``mapping(topic, category)`` and ``fallback(keyword, category)`` are dimensions.
    """
    each = channels.select(key, F.posexplode_outer(topics).alias("pos", "topic")).join(mapping, "topic", "left")
    first = each.groupBy(key, "category").agg(F.min("pos").alias("pos"))
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("pos", "category")))), lambda s: s["category"])
    found = first.groupBy(key).agg(held.alias("categories"))
    words = channels.select(key, F.posexplode(F.split(F.lower(name), " ")).alias("pos", "keyword")).join(fallback, "keyword")
    spare = words.groupBy(key).agg(F.min_by("category", F.struct("pos", "category")).alias("spare"))
    primary = F.coalesce(F.get("categories", F.lit(0)), F.col("spare"))
    return found.join(spare, key, "left").select(key, primary.alias("category"), "categories")
