"""Answers, queues and events as streams."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path
from ..sources.tasks import answers_of


def read(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, answer of the answer files in a folder, as they arrive."""
    rows = spark.readStream.schema("event_id long, result string").option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return answers_of(rows)


def votes(answers: DataFrame) -> DataFrame:
    """a, b, n, total so far; every answer is a vote, repeated ones too."""
    return answers.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("answer").alias("total"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if "." in name else path)


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums by day and type; late events count within two days."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def run_once(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """All that is there now, through the stream into a Parquet table in the shared folder (the last state in complete mode)."""
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def resume(stream: DataFrame, spark: SparkSession, out: str, state: str) -> DataFrame:
    """What has come since the checkpoint in `state` (or from the start) goes through the stream and is added to the table `out`; all of it so far."""

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a loss replaces what it wrote before.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def sampled(spark: SparkSession, seconds: int) -> DataFrame:
    """at, load: the driver's load, once a second."""
    rows = []
    for _ in range(seconds):
        rows.append((time.time(), os.getloadavg()[0]))
        time.sleep(1)
    return spark.createDataFrame(rows, "at double, load double")
