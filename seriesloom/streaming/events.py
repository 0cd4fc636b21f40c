"""Streams of events: counts by window with a bound on lateness, and an upsert of results for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import resume_upsert


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and mean value by event type and window; rows later than ``late`` behind the newest are dropped."""
    kept = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def upsert_batches(stream: DataFrame, folder: str, keys: list[str], ordinal: str, checkpoint: str) -> StreamingQuery:
    """Merge every batch into the newest version of a table, each version in a folder of its own."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = latest(spark, folder)
        merged = resume_upsert(before, batch, keys, ordinal) if before is not None else batch
        merged.write.mode("overwrite").parquet(f"{folder}/version={number:010d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest complete version, if there is one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(done[-1]) if done else None
