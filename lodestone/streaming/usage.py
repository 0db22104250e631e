"""Usage over event streams, by the same rules in batch and in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events older than this against the newest one seen are dropped by a stream, as the usage log drops them.
RETENTION = "24 hours"


def hourly(events: DataFrame) -> DataFrame:
    """(hour, event_type, calls, total). On a stream, late events are accepted for ``RETENTION``."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("at", RETENTION)
    return e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "calls", "total")


def follow(spark: SparkSession, folder: str, schema, out: str, checkpoint: str):
    """Reads every Parquet file that the folder has now, each exactly once over restarts, and appends finished hours to ``out``. Returns the query."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return hourly(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event_id once; on a stream its state is dropped after ``RETENTION``."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        return e.withWatermark("at", RETENTION).dropDuplicatesWithinWatermark(["event_id"]).drop("at")
    return e.dropDuplicates(["event_id"]).drop("at")
