"""Interval overlap join by bins of doubling width, and how many intervals are open at once by a sweep line.

Times are zoneless or zoned columns; intervals hold both ends. Intervals that end before they start, or lack an end, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchloom.functions.clock import micros, zoneless


def _spans(df: DataFrame, keys: list[str], start: str, end: str, name: str, unit: int) -> DataFrame:
    """Keys, bounds in microseconds, the whole row as ``name``, and the level at which it covers at most two bins."""
    rows = df.select(*keys, micros(df, start).alias(f"{name}_s"), micros(df, end).alias(f"{name}_e"), F.struct(*df.columns).alias(name)).filter(F.col(f"{name}_s") <= F.col(f"{name}_e"))
    length = F.greatest(F.lit(1.0), (F.col(f"{name}_e") - F.col(f"{name}_s")) / unit)
    return rows.withColumn(f"{name}_l", F.ceil(F.log2(length)).cast("int"))


def _width(unit: int) -> Column:
    return F.expr(f"{unit}L * shiftleft(1L, _level)")


def _binned(spans: DataFrame, name: str, levels: int, unit: int) -> DataFrame:
    """A row for each bin that the interval touches at its own level and at all above: at most two a level."""
    level = F.explode(F.sequence(F.col(f"{name}_l"), F.lit(levels)))
    rows = spans.withColumn("_level", level)
    first, last = (F.floor(F.col(f"{name}_{x}") / _width(unit)) for x in "se")
    return rows.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], unit_seconds: int = 900) -> DataFrame:
    """Every pair of intervals with equal keys that have an instant in common: structs ``a`` and ``b`` of their rows.

    A bin of level ``k`` is ``unit_seconds * 2**k`` wide. A pair meets at the level of the longer interval, in the bin where the later
    one starts, so it comes up once; there are equality conditions alone, thus hash or merge joins and AQE's splitting of
    skewed bins. Rows grow by twice the number of levels at most, which is the logarithm of the longest interval in units; a
    small job finds that one first.
    """
    unit = unit_seconds * 1_000_000
    a, b = _spans(left, keys, *left_span, "a", unit), _spans(right, keys, *right_span, "b", unit)
    longest = a.agg(F.max("a_l").alias("x")).unionByName(b.agg(F.max("b_l").alias("x"))).agg(F.max("x")).first()[0] or 0
    met = _binned(a, "a", longest, unit).join(_binned(b, "b", longest, unit), [*keys, "_level", "_bin"])
    own_level = F.col("_level") == F.greatest("a_l", "b_l")
    later = F.floor(F.greatest("a_s", "b_s") / _width(unit))
    real = (F.col("a_s") <= F.col("b_e")) & (F.col("b_s") <= F.col("a_e"))
    return met.filter(own_level & (F.col("_bin") == later) & real).select("a", "b")


def _sums_before(df: DataFrame, keys: list[str], by: str, value: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def concurrency(spans: DataFrame, start: str, end: str, keys: list[str] | None = None, slice_seconds: int = 3600) -> DataFrame:
    """``*keys, slice_start, peak, peak_ts`` for each slice of time in which an interval starts or ends: the most open at once and when first.

    Without keys it is over all rows, and yet no task sees more than a slice: changes are summed by instant, then by slice; what was open before a
    slice is a running sum over slices (one short row each), and inside a slice the sweep goes on from there. An interval is open from its start to its
    end, both included.
    """
    keys = list(keys or [])
    unit = slice_seconds * 1_000_000
    own = spans.select(*keys, micros(spans, start).alias("s"), micros(spans, end).alias("e")).filter(F.col("s") <= F.col("e"))
    # an end takes effect a microsecond later, as intervals hold their end
    steps = own.select(*keys, F.inline(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct((F.col("e") + 1).alias("at"), F.lit(-1).alias("d")))))
    steps = steps.groupBy(*keys, "at").agg(F.sum("d").alias("d")).withColumn("slice", F.floor(F.col("at") / unit))
    sums = steps.groupBy(*keys, "slice").agg(F.sum("d").alias("d"))
    whole = keys or [F.lit(0)]
    before = sums.select(*keys, "slice", _sums_before(sums, whole, "slice", "d").alias("open"))
    inside = Window.partitionBy(*keys, "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    swept = steps.join(before, [*keys, "slice"]).withColumn("n", F.col("open") + F.sum("d").over(inside))
    top = swept.groupBy(*keys, "slice").agg(F.max_by(F.struct("n", "at"), F.struct("n", -F.col("at"))).alias("top"), F.first("open").alias("open"))
    # with nothing above it, the number open when the slice begins is the peak
    start_us = F.col("slice") * unit
    held = F.col("open") >= F.col("top.n")
    return top.select(*keys, zoneless(start_us).alias("slice_start"), F.greatest("open", F.col("top.n")).alias("peak"), zoneless(F.when(held, start_us).otherwise(F.col("top.at"))).alias("peak_ts"))
