"""Sessions over a stream: the batch operator's split, by session windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import shared_dir


def session_stream(events: DataFrame, gap: str = "60 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """``user_id, start_ts, end_ts, events`` for a streaming (or batch) table of timed events.

    Events later than the watermark are dropped from a stream that is written in append mode.
    """
    seen = events.withColumn("_t", F.col(time).cast("timestamp")).filter(F.col("_t").isNotNull())
    seen = seen.withWatermark("_t", late) if events.isStreaming else seen
    out = seen.groupBy("user_id", F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("events"), F.max("_t").alias("end_ts"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "events")


def drain(sessions: DataFrame, path: str) -> None:
    """Run a stream of sessions over all that is there now; ``path`` holds every session so far, open ones too.

    Each micro-batch replaces the table; state and progress are in the shared folder.
    """
    spark = sessions.sparkSession

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = sessions.writeStream.outputMode("complete").option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of its files, with the table's own schema."""
    # a pattern that only this path matches: the source takes a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
