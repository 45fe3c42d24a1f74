"""Incremental metric collection.

New metric rows arrive as a stream. They are stored per micro-batch in a folder of their own, so a batch that is
retried after a failure overwrites itself; the running roll-ups are streaming aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmine import schema
from shelfmine.operators import telemetry
from shelfmine.operators.rollups import Rollups


def metric_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of metric files appended to a folder."""
    return spark.readStream.schema(schema.QUERY_METRICS).json(folder)


def store(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append trackable rows to ``folder``; nothing of an untracked session is ever written."""

    def write(batch: DataFrame, number: int) -> None:
        telemetry.trackable(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def roll_up(stream: DataFrame, rollups: Rollups, checkpoint: str) -> StreamingQuery:
    """Keep ``rollups`` up to date. A micro-batch that is done again after a failure overwrites what it wrote."""
    return (
        stream.writeStream.foreachBatch(rollups.add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Everything stored so far, one row per query: the facts of its first row, rating and comment of its last one."""
    rows = spark.read.schema(schema.QUERY_METRICS + ", batch long").parquet(folder)
    return telemetry.one_per_query(rows, ("batch", "timestamp")).drop("batch")


def running_tool_usage(stream: DataFrame) -> DataFrame:
    """Calls per tool over everything seen."""
    tracked = telemetry.trackable(stream)
    return tracked.select(F.explode("tool_calls").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))


def running_summary(stream: DataFrame) -> DataFrame:
    """The summary row over everything seen."""
    return telemetry.summary(telemetry.trackable(stream))
