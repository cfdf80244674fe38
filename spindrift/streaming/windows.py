"""Event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) of a stream (ts, event_type, value); rows later than ``late`` are dropped once their window closed."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def daily_counts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Runs the stream over all that is there and returns what it wrote."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parq*t")
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{k:06d}")

    q = windowed(src).writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max((p["batchId"] for p in q.recentProgress), default=0)
    out = spark.read.parquet(f"{folder}/out/{last:06d}")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")
