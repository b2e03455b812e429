"""Event-time windows over the events table, as a stream or as a batch. These go beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, events, total) of each window; with `late`, a watermark bounds the state."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        e = e.withWatermark("at", late)
    g = e.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "events")


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def watch(spark: SparkSession, path: str, schema, run, checkpoint: str):
    """Run `run(batch, id)` on every file that arrives, then stop: the incremental form of a watch mode."""
    return stream(spark, path, schema).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
