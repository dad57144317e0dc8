"""Event and file stores as partitioned Parquet: users are dealt to buckets, so directories stay few.

The number of buckets belongs to a store: give the same one to all calls for a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import shared_dir

BUCKETS = 64


def _bucketed(df: DataFrame, user: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(user).cast("string")), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str, user: str, mode: str, buckets: int) -> None:
    # a bucket in eight tasks, so in at most eight files a write
    dealt = _bucketed(df, user, buckets).repartition("bucket", F.pmod(F.xxhash64(user, F.lit(7)), F.lit(8))).sortWithinPartitions("bucket", user)
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_events(df: DataFrame, path: str, user: str = "user_id", mode: str = "append", buckets: int = BUCKETS) -> None:
    _write(df, path, user, mode, buckets)


def read_events(spark: SparkSession, path: str, users: DataFrame | list | None = None, user: str = "user_id", buckets: int = BUCKETS) -> DataFrame:
    """Stored rows, of some users only if given: a list prunes buckets and rows in the scan, a DataFrame is joined."""
    df = spark.read.parquet(path)
    if isinstance(users, DataFrame):
        df = df.join(_bucketed(users.select(user).distinct(), user, buckets), ["bucket", user], "left_semi")
    elif users is not None:
        keys = spark.createDataFrame([(str(u),) for u in users], "u string")
        found = [r.bucket for r in _bucketed(keys, "u", buckets).select("bucket").distinct().collect()]  # at most ``buckets``
        df = df.filter(F.col("bucket").isin(found) & F.col(user).isin(users))
    return df.drop("bucket")


def write_files(files: DataFrame, path: str, token: str = "token", mode: str = "append", buckets: int = BUCKETS) -> None:
    """Raw members as they were extracted: ``token, filename, content_type, content, size_bytes, timezone, created_at``."""
    _write(files, path, token, mode, buckets)


def read_files(spark: SparkSession, path: str, tokens: DataFrame | list | None = None, token: str = "token", buckets: int = BUCKETS) -> DataFrame:
    return read_events(spark, path, tokens, token, buckets)


def sessions(df: DataFrame, token: str = "token") -> DataFrame:
    """One row per session: its file names, time zone and when it was made."""
    return df.groupBy(token).agg(F.array_sort(F.collect_set("filename")).alias("files"), F.max("timezone").alias("timezone"), F.max("created_at").alias("created_at"))


def _keep(spark: SparkSession, path: str, touched: list[int], kept: DataFrame, user: str, buckets: int) -> None:
    """Replace the touched buckets by ``kept``, which is written aside first; a bucket that has nothing left goes."""
    aside = shared_dir(spark)
    kept.write.parquet(aside)
    rest = spark.read.schema(kept.schema).parquet(aside)
    left = {r.bucket for r in _bucketed(rest.select(user), user, buckets).select("bucket").distinct().collect()}  # at most ``buckets``
    _write(rest, path, user, "overwrite", buckets)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in set(touched) - left:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"bucket={k}"), True)
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)


def delete(spark: SparkSession, path: str, users: DataFrame, user: str = "user_id", buckets: int = BUCKETS) -> None:
    """Take the users of a DataFrame out of the store; only their buckets are rewritten."""
    gone = _bucketed(users.select(user).distinct(), user, buckets)
    touched = [r.bucket for r in gone.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        _keep(spark, path, touched, stored.join(gone, ["bucket", user], "left_anti").drop("bucket"), user, buckets)


def retained(df: DataFrame, now, max_age_hours: int = 24, created: str = "created_at") -> DataFrame:
    """Rows of sessions not older than ``max_age_hours``; those without a time stay."""
    return df.filter(F.col(created).isNull() | (F.col(created) >= F.lit(now) - F.expr(f"interval {max_age_hours} hours")))


def expire(spark: SparkSession, path: str, now, max_age_hours: int = 24, created: str = "created_at", user: str = "token", buckets: int = BUCKETS) -> None:
    """Drop sessions older than ``max_age_hours`` from a store; buckets without such a session stay as they are."""
    stored = spark.read.parquet(path)
    old = stored.filter(F.col(created) < F.lit(now) - F.expr(f"interval {max_age_hours} hours"))
    touched = [r.bucket for r in old.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        _keep(spark, path, touched, retained(stored.filter(F.col("bucket").isin(touched)), now, max_age_hours, created).drop("bucket"), user, buckets)
