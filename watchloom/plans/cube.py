"""One aggregate for many reports: counts at all levels of user, month, weekday, hour and engagement, from a single scan.

Rows are first counted by the finest cells, so what grouping sets multiply is cells (at most a few thousand for a user and month), not events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("user_id", "month", "weekday", "hour", "engagement")
#: Levels by name; those without ``user_id`` are over all users.
LEVELS: dict[str, tuple[str, ...]] = {
    "all": (), "user": ("user_id",), "user_month": ("user_id", "month"), "user_weekday": ("user_id", "weekday"), "user_hour": ("user_id", "hour"), "user_engagement": ("user_id", "engagement"),
    "user_weekday_hour": ("user_id", "weekday", "hour"), "user_month_engagement": ("user_id", "month", "engagement"), "month": ("month",), "weekday_hour": ("weekday", "hour"), "engagement": ("engagement",),
}


def level_id(level: str) -> int:
    """Grouping id of a level: a bit for each axis it leaves out, the first axis highest."""
    return sum(1 << (len(AXES) - 1 - k) for k, axis in enumerate(AXES) if axis not in LEVELS[level])


def activity_cube(watch: DataFrame, levels: tuple[str, ...] = tuple(LEVELS)) -> DataFrame:
    """``level, *AXES, n, first_seq``: watches with a time at each of ``levels``; axes that a level leaves out are null."""
    slots = {"month": F.date_format("ts", "yyyy-MM"), "weekday": F.weekday("ts"), "hour": F.hour("ts")}
    timed = watch.filter(F.col("ts").isNotNull()).select("user_id", "seq", "engagement", *[c.alias(k) for k, c in slots.items()])
    cells = timed.groupBy(*AXES).agg(F.count("*").alias("cell_n"), F.min("seq").alias("cell_seq"))
    sets = cells.groupingSets([[F.col(a) for a in LEVELS[x]] for x in levels], *[F.col(a) for a in AXES])
    out = sets.agg(F.grouping_id().alias("g"), F.sum("cell_n").alias("n"), F.min("cell_seq").alias("first_seq"))
    name = F.element_at(F.create_map(*[x for level in levels for x in (F.lit(level_id(level)), F.lit(level))]), F.col("g").cast("int"))
    return out.select(name.alias("level"), *AXES, "n", "first_seq")


def level(cube: DataFrame, name: str) -> DataFrame:
    """The rows and axes of one level."""
    return cube.filter(F.col("level") == name).select(*LEVELS[name], "n", "first_seq")


def filled(cube: DataFrame, axis: str, size: int) -> DataFrame:
    """``user_id, axis, n, share`` of all ``size`` slots of a user's level, zeros included; ``share`` is of the fullest slot."""
    held = level(cube, f"user_{axis}").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(axis, "n"))).alias("m"), F.max("n").alias("top"))
    n = F.coalesce(F.element_at("m", F.col(axis)), F.lit(0))
    return held.select("user_id", "m", "top", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(axis)).select("user_id", axis, n.alias("n"), (n / F.col("top")).alias("share"))
