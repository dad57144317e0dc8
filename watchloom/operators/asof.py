"""As-of join: each row with the version that held at its time, by a sorted union and no join.

Rows and versions are laid together, one shuffle by key, sorted by time, and the last version seen is carried on. With ``slices`` a key's time line
is also cut into slices, so that one hot key is many tasks: the last version of each slice is found first (a small aggregate, at most a row a slice)
and carried over the slices that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.clock import micros


def latest(versions: DataFrame, keys: list[str], time: str, order: str) -> DataFrame:
    """One version for each key and time: the last by ``order``."""
    rest = [c for c in versions.columns if c not in (*keys, time)]
    best = versions.groupBy(*keys, time).agg(F.max_by(F.struct(*rest), order).alias("v"))
    return best.select(*keys, time, "v.*")


def asof_join(rows: DataFrame, versions: DataFrame, keys: list[str], time: str, version_time: str, tolerance_seconds: float | None = None, slices: str | None = None) -> DataFrame:
    """``rows`` with the columns of the last version at or before ``time``, nulls where there is none (or it is older than the tolerance).

    Both have the ``keys``; versions have one row for a key and time (see ``latest``). Rows with a null key or time have no version. The columns
    of a version other than the keys must not be columns of ``rows``. ``slices`` is the length of a slice of time, as ``1 day``.
    """
    own = [c for c in versions.columns if c not in keys]
    left = rows.select(*keys, micros(rows, time).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    right = versions.select(*keys, micros(versions, version_time).alias("_at"), F.lit(0).alias("_side"), F.struct(*own).alias("_version"))
    right = right.filter(F.col("_at").isNotNull() & ~F.greatest(F.lit(False), *[F.col(k).isNull() for k in keys]))
    part = list(keys)
    if slices:
        width = F.lit(_micros(rows, slices))
        left, right = (x.withColumn("_slice", F.floor(F.col("_at") / width)) for x in (left, right))
        last = right.groupBy(*keys, "_slice").agg(F.max_by(F.struct("_at", "_version"), "_at").alias("_last"))
        # what a slice starts with: the last version of the nearest slice before it that has one; asked for slices that hold rows only
        asked = left.select(*keys, "_slice").distinct().join(last, [*keys, "_slice"], "full_outer")
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        start = asked.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(before).alias("_last")).filter(F.col("_last").isNotNull())
        right = right.unionByName(start.select(*keys, F.col("_last._at").alias("_at"), F.lit(0).alias("_side"), F.col("_last._version").alias("_version"), "_slice"))
        part.append("_slice")
    both = left.withColumn("_version", F.lit(None).cast(right.schema["_version"].dataType)).unionByName(right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)))
    held = Window.partitionBy(*part).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("_side") == 0, F.struct("_at", "_version")), ignorenulls=True).over(held)
    out = both.withColumn("_held", carried).filter(F.col("_side") == 1)
    good = F.col("_at").isNotNull()
    if tolerance_seconds is not None:
        good = good & (F.col("_at") - F.col("_held._at") <= int(tolerance_seconds * 1_000_000))
    return out.select("_row.*", *[F.when(good, F.col("_held._version")[c]).alias(c) for c in own])


def _micros(df: DataFrame, length: str) -> int:
    """Microseconds of an interval such as ``6 hours``."""
    return df.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval '{length}') AS us").first().us
