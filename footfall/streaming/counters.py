"""Streaming counters: hits per micro-batch in a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.counters import KEY, as_changes, increments
from footfall.schemas import struct
from footfall.streaming.ledger import open_ledger, read_ledger, write_batch

LEDGER = struct("project_id string, counter_key string, hits bigint, counted_at timestamp")


def count_stream(events: DataFrame, counters: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Count rule hits; a batch leaves one row per counter it touched.

    ``counters`` loads the rules; it is called for every batch, so a new rule counts from then on.
    """
    open_ledger(events.sparkSession, path, LEDGER)

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = increments(batch, counters(batch.sparkSession))
        write_batch(hits.withColumn("counted_at", F.current_timestamp()), path, batch_id)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ledger_totals(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path, LEDGER).groupBy(*KEY).agg(F.sum("hits").alias("hits"))


def ledger_changes(spark: SparkSession, path: str, first_seq: int = 0) -> DataFrame:
    """The ledger as increments for the counter log, in batch order, at the times of the batches."""
    rows = read_ledger(spark, path, LEDGER)
    return as_changes(rows, F.col("batch") + first_seq, F.col("counted_at"))
