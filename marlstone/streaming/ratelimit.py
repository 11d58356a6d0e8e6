"""Rate-limit windows as a stream: tumbling and sliding counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def window_counts(events: DataFrame, seconds: int, every: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """(user_id, w, n) of a stream of events (user_id, ts) in windows of so many seconds, one beginning every `every`
    seconds (tumbling without it). A window's state goes once the watermark has passed its end, and events that come
    later than that are not counted.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    slide = f"{every} seconds" if every else None
    return timed.groupBy("user_id", F.window("ts", f"{seconds} seconds", slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def replay_counts(spark: SparkSession, path: str, seconds: int, every: int | None = None, **options: str) -> DataFrame:
    """(user_id, window_start, n): runs the stream over stored events to its end. options are those of the file source.

    Each batch writes only the windows it has changed (update mode), into a folder of its own that a repeated batch
    overwrites; counts only grow, so a window's last count is its greatest. The files lie in the shared folder.

    What is counted depends on how files fall into batches where these are several: an event is dropped if an earlier batch
    has moved the watermark past its window. In one batch, as in a count of the stored table, nothing is late.
    """
    schema = spark.read.parquet(path).schema
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    parent, _, leaf = path.rpartition("/")
    # A stream reads folders: one file is picked from its folder by name.
    stream = spark.readStream.schema(schema).options(**options)
    stream = stream.parquet(path) if _is_folder(spark, path) else stream.option("pathGlobFilter", leaf).parquet(parent)

    def write(batch: DataFrame, number: int) -> None:
        batch.select("user_id", F.unix_seconds("w.start").alias("window_start"), "n").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run = window_counts(stream, seconds, every).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    written = spark.read.schema("user_id long, window_start long, n long").parquet(f"{folder}/out")
    return written.groupBy("user_id", "window_start").agg(F.max("n").alias("n"))


def swept(buckets: DataFrame, cutoff) -> DataFrame:
    """Buckets (window_start) that began at the cutoff or later; the older ones are deleted."""
    return buckets.where(F.col("window_start") >= cutoff)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
