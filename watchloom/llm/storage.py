"""Intermediate tables, which go to the shared folder of the cluster, and the size of Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from watchloom.session import shared_dir, ship

__all__ = ["bounded", "dealt", "materialise", "partitions", "release", "shared_dir", "unused"]

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The package is on the workers, and Arrow batches hold 4 MB at most, as texts are long.

    A bound that the session has set itself is left alone.
    """
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH_BYTES):
        spark.conf.set(_BATCH_BYTES, "4m")
    return ship(spark)


def materialise(df: DataFrame | Iterable[DataFrame], free: bool = False) -> DataFrame:
    """Cut the lineage of ``df``: write it once to the shared folder and read it back.

    With ``free`` the driver then collects its garbage, which is when Spark deletes the shuffle files of what is done.
    Several frames of the same columns are the parts of one table and are written one after another, so that with
    ``free`` the shuffle files of one part are on disk at a time.
    """
    path = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, schema = part.sparkSession, part.schema
        path = path or shared_dir(spark)
        part.write.mode("append").parquet(path)
        if free:
            release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """The driver collects its garbage, so that Spark deletes the shuffle files of what is done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dealt(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose rows grow with the input: both sides are shuffled, none is broadcast.

    Spark goes by the bytes of the files, which are packed and not yet exploded, when it takes a side as small, and the driver
    then builds a table of all its rows, several times as large.
    """
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
