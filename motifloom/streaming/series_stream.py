"""A series of windowed sums from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_sums(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """``slot, s, n``: sums of event values by tumbling window; events more than ``delay`` behind the latest one are refused."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", window).alias("w")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slot"), "s", "n")


def build_series(
    spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str, window: str = "1 hour", glob: str = "events*.parquet", delay: str = "1 hour"
) -> DataFrame:
    """Read event files as a stream, as far as there are any, and keep the sums of all windows in a Parquet folder.

    Windows that a batch changes are written by batch and number, so a batch that runs again replaces its own rows;
    of a window the latest batch counts.  State is dropped behind the watermark.
    """
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        windowed_sums(events, window, delay)
        .writeStream.outputMode("update")
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    latest = spark.read.parquet(target).groupBy("slot").agg(F.max(F.struct("batch", "s", "n")).alias("m"))
    return latest.select("slot", "m.s", "m.n")
