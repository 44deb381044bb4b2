"""Incremental loads: files that land become upserts into a table, and event-time counts with a bound on lateness."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.upsert import overwrite
from tidegrid.session import shared_dir


def upsert_stream(source: DataFrame, target: str, keys: list[str], order: list[Column], checkpoint: str):
    """Writes each micro-batch over the parquet table at ``target`` (a new version per batch); starts and returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = spark.read.parquet(f"{target}/v={number - 1}") if number else batch.limit(0)
        overwrite(versions, batch, keys, order).write.mode("overwrite").parquet(f"{target}/v={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per event-time window and key; rows later than ``late`` are past the watermark."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", every), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed counts of the events table run as a stream over its file until all is read."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    name = f"daily_counts_{uuid.uuid4().hex}"
    place = f"{shared_dir(spark).rstrip('/')}/{name}"
    query = windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
