"""Windowed aggregates of event streams, and runs of a stream to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import shared_folder


def event_windows(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; windows close once the watermark passes them."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.window("at", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Process what is available and return the sink's rows; state and sink lie in the shared folder.

    In complete mode each batch is the whole result and replaces the one before.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch=-1")
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
