"""Streaming traffic ingest: every item with its outcome, and the counts of every micro-batch.

The counts are observed while the items are written, so nothing is read or checked twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from footfall.operators.traffic_ingest import checked_public_traffic, checked_signed_traffic
from footfall.schemas import TRAFFIC_METRICS, struct
from footfall.sources.landing import items_of
from footfall.streaming.ledger import open_ledger, read_ledger, write_batch

ITEMS = struct("batch_id string, item_no int, reason string")
for _field in TRAFFIC_METRICS.fields:
    ITEMS = ITEMS.add(_field)
COUNTS = struct("received bigint, accepted bigint, rejected bigint")


def traffic_stream(requests: DataFrame, path: str, checkpoint: str, salt: str = "", public: bool = False, once: bool = False) -> StreamingQuery:
    """Write the items of landed requests with ``reason`` (null if accepted) to a ledger, and their counts to one beside it.

    Lines that are no records and requests without items are rejected items.
    """
    check: Callable[..., DataFrame] = checked_public_traffic if public else checked_signed_traffic
    for part, schema in (("items", ITEMS), ("counts", COUNTS)):
        open_ledger(requests.sparkSession, f"{path}/{part}", schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        seen, good = Observation(), F.count(F.when(F.col("reason").isNull(), 1))
        rows = check(items_of(batch), salt).observe(seen, F.count(F.lit(1)).alias("received"), good.alias("accepted"))
        write_batch(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ITEMS]), f"{path}/items", batch_id)
        found = seen.get
        counts = (found["received"], found["accepted"], found["received"] - found["accepted"])
        write_batch(batch.sparkSession.createDataFrame([counts], COUNTS), f"{path}/counts", batch_id)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def batch_answers(items: DataFrame) -> DataFrame:
    """Received, accepted and rejected items of every request; lines that are no records are one batch without an id."""
    sums = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("received"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"))
    return sums.select("batch_id", "received", "accepted", (F.col("received") - F.col("accepted")).alias("rejected"), (F.col("accepted") == 0).alias("failed"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, f"{path}/items", ITEMS)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts by micro-batch."""
    return read_ledger(spark, f"{path}/counts", COUNTS).where(F.col("batch") >= 0)
