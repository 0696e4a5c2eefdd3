"""Page views and distinct visitors while streaming, exact for any order of files.

A batch leaves one row per project, bucket and device with its page views.  Rows of a device add
up to one, so sets of devices merge by a sum, and visitors are the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.json import not_bot
from footfall.operators.metrics import zero_filled
from footfall.operators.traffic import PAGE_VIEW
from footfall.ranges import Granularity, TimeRange, in_project
from footfall.schemas import struct
from footfall.streaming.runs import DIGITS, FAN, Runs

SIZES = ("hour", "day")
SETS = struct("project_id string, bucket timestamp, device_id string, device_hash string, page_views bigint")
_SAME = ["project_id", "bucket", "device_id", "device_hash"]


def merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_SAME).agg(F.sum("page_views").alias("page_views"))


def visitor_sets(path: str, fan: int = FAN, digits: int = DIGITS) -> Runs:
    return Runs(path, SETS, "device_hash", merged, fan, digits)


def devices_of(metrics: DataFrame, size: str = "day") -> DataFrame:
    """The devices of some metrics by bucket, without bots; a null device views pages but is no visitor."""
    views = F.when(F.col("metric_type") == PAGE_VIEW, 1).otherwise(0).cast("bigint")
    bucket = Granularity.of(size, SIZES).bucket("created_at").cast("timestamp")
    known = metrics.where(not_bot(F.col("metadata"))).select(
        "project_id", bucket.alias("bucket"), "device_id", F.md5(F.coalesce("device_id", F.lit(""))).alias("device_hash"), views.alias("page_views")
    )
    return merged(known)


def visitor_stream(metrics: DataFrame, sets: Runs, checkpoint: str, size: str = "day", once: bool = False) -> StreamingQuery:
    """Add the devices of every micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sets.add(devices_of(batch, size), batch_id)
        sets.prune(batch.sparkSession, batch_id)

    writer = metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def traffic_of(spark: SparkSession, sets: Runs, batches: int, project_id: str, rng: TimeRange, size: str = "day") -> DataFrame:
    """Page views and visitors per bucket after so many batches, gaps filled with zeros; the range has whole buckets."""
    rows = merged(in_project(sets.rows(spark, batches), project_id, "bucket", rng))
    counted = rows.groupBy("bucket").agg(F.sum("page_views").alias("page_views"), F.count("device_id").alias("visitors"))
    return zero_filled(spark, [counted], ["page_views", "visitors"], Granularity.of(size, SIZES), rng)
