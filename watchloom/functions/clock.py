"""Two clocks: dates and hours go by the wall clock, gaps and durations by instants.

Events hold ``ts``, the effective local time, and may hold ``ts_utc``, the instant, both without a zone. Nothing here casts a zoneless
time to one with a zone, so no result depends on the zone of the session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WALL, INSTANT = "ts", "ts_utc"


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970 of a column of ``df``; a zoneless one is taken as UTC."""
    c = F.col(time)
    if dict(df.dtypes).get(time) == "timestamp":
        return F.unix_micros(c)
    seconds = F.unix_date(F.to_date(c)).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{time}`)") * 1_000_000).cast("long")


def zoneless(us: Column) -> Column:
    """The zoneless UTC time of microseconds since 1970."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)"))


def with_instants(df: DataFrame, wall: str = WALL, instant: str = INSTANT, name: str = "_us") -> DataFrame:
    """``df`` with the microseconds of each row's instant; without one the wall clock stands for it."""
    at = F.coalesce(micros(df, instant), micros(df, wall)) if instant in df.columns else micros(df, wall)
    return df.withColumn(name, at)
