"""Counts of events in tumbling windows, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraza.sources import scratch


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and their summed value of each type and window; events later than the watermark are left out of closed windows."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "value")


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the counts over what there is, in batches, and gives each window's last state; state and results are in the shared folder.

    Each batch writes the windows that it changed, so the state of those that the watermark has closed is dropped.
    """
    out = scratch.path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = window_counts(events)
    write = counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    write.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in counts.schema)}, batch long").parquet(f"{out}/rows")
    last = rows.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "value"), "batch").alias("last"))
    return last.select("day", "event_type", "last.n", "last.value")
