"""Streaming twins: windowed counts, sessions and first-seen keys over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_counts(events: DataFrame, term: str, ts: str, width: str, late: str) -> DataFrame:
    """(term, start, n): tumbling counts, aligned to the epoch; events later than the watermark are left out."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    return timed.groupBy(F.col(term).alias("term"), F.window("_ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("term", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): runs of events of a key with no gap as long as gap."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if events.isStreaming else timed
    return timed.groupBy(F.col(key).alias("key"), F.session_window("_ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Events whose key was not seen within the watermark."""
    return events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark([key]).drop("_ts")


def run_available(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a Parquet table beside its checkpoint, and reads it."""
    out = f"{checkpoint}/{name}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{checkpoint}/{name}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
