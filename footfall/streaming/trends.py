"""Streaming page views per bucket.

Every micro-batch leaves its own counts in the ledger and they add up, so the
result does not depend on the order in which files arrive and nothing is late.
Distinct visitors need the full set of devices of a bucket, so the stream only
counts views; month and year sums come from the days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.json import not_bot
from footfall.operators.traffic import PAGE_VIEW
from footfall.schemas import struct
from footfall.streaming.ledger import open_ledger, read_ledger, write_batch

# Window length and offset; weeks start on Monday, the epoch was a Thursday.
WINDOWS = {"hour": ("1 hour", "0 seconds"), "day": ("1 day", "0 seconds"), "week": ("7 days", "4 days")}
LEDGER = struct("project_id string, bucket timestamp, page_views bigint")


def page_view_counts(metrics: DataFrame, granularity: str = "day") -> DataFrame:
    """Page views of every project and bucket in some rows."""
    length, offset = WINDOWS[granularity]
    return (
        metrics.where(not_bot(F.col("metadata")) & (F.col("metric_type") == PAGE_VIEW))
        .groupBy("project_id", F.window(F.col("created_at").cast("timestamp"), length, length, offset).alias("w"))
        .agg(F.count(F.lit(1)).alias("page_views"))
        .select("project_id", F.col("w.start").alias("bucket"), "page_views")
    )


def page_view_stream(metrics: DataFrame, path: str, checkpoint: str, granularity: str = "day", once: bool = False) -> StreamingQuery:
    """Write the page views of every micro-batch."""
    open_ledger(metrics.sparkSession, path, LEDGER)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(page_view_counts(batch, granularity), path, batch_id)

    writer = metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def page_views(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path, LEDGER).groupBy("project_id", "bucket").agg(F.sum("page_views").alias("page_views"))
