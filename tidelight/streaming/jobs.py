"""Structured Streaming forms of the batch operators.

A stream is read from Parquet files as they come; aggregates keep state by key
and event time, with a watermark where state must end. ``run`` processes all
that is there and stops, writing each batch to a folder that executors share, so
a restart from the checkpoint gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelight.sources.shared import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Process what is there: complete results replace the table, others are added to it."""
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = out if mode == "complete" else f"{out}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out if mode == "complete" else f"{out}/*")


def time_bars(events: DataFrame, width: str) -> DataFrame:
    """Open, high, low, close and count of each user's tumbling windows."""
    at = F.struct("ts", "event_id")
    return events.groupBy("user_id", F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n")
    )


def sliding_counts(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Stretches of a user's events with no gap as long as ``gap``."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First event of each key; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def book_levels(events: DataFrame) -> DataFrame:
    """Latest size of each price level, by replacement deltas in event order; late deltas can't roll a level back.

    The state is one row a level, so it is bounded by the ticks that occur.
    """
    side = F.when(F.col("event_type").isin("purchase", "view"), "bid").otherwise("ask")
    tick = F.get_json_object("props", "$.k").cast("long")
    deltas = events.select(side.alias("side"), tick.alias("tick"), "event_id", F.floor("value").alias("size"))
    return deltas.groupBy("side", "tick").agg(F.max("event_id").alias("event_id"), F.max_by("size", "event_id").alias("size"))
