"""Streaming event ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from footfall.functions.text import is_blank, project_id
from footfall.operators.events import as_events, ingest_events
from footfall.operators.gate import admitted, gate_as_of
from footfall.schemas import EVENTS
from footfall.streaming.key_index import key_index
from footfall.streaming.ledger import open_ledger, read_batch, write_batch
from footfall.streaming.runs import Runs

#: A micro-batch with more keys than this is not broadcast.
BROADCAST_KEYS = 200_000

#: Stored batch rows: the event and the key it took.
LEDGER = T.StructType(EVENTS.fields + [T.StructField("key_hash", T.StringType())])


def gated_stream(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Signed requests that may pass, by the devices known when the stream starts."""
    return admitted(requests, devices)


def gate_stream(
    requests: DataFrame, devices: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write the requests that may pass; ``devices`` is loaded for every batch, so new devices and bans count."""
    open_ledger(requests.sparkSession, path, requests.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(admitted(batch, devices(batch.sparkSession)), path, batch_id)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def gate_as_of_stream(
    requests: DataFrame, history: Callable[[SparkSession], DataFrame], path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Write every request with the ``reason`` that held when it was received.

    ``history`` is loaded for every batch and only grows: versions later than a request do not
    touch it, so a replay of the stream with today's history gives the answers of its time.
    """
    spark = requests.sparkSession
    open_ledger(spark, path, T.StructType(requests.schema.fields + [T.StructField("reason", T.StringType())]))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(gate_as_of(batch, history(batch.sparkSession)), path, batch_id)

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_stream(
    items: DataFrame, path: str, checkpoint: str, known_keys: Callable[[SparkSession], DataFrame] | None = None,
    once: bool = False, index: Runs | None = None,
) -> StreamingQuery:
    """Write accepted events batch by batch; a key is taken once, for good.

    The keys of earlier batches are in ``index`` (by default beside the ledger), of which a batch opens a bounded part.
    No state grows in memory, and a repeated batch does not see its own keys.  ``known_keys``
    loads keys taken elsewhere; it is called for every batch.
    """
    spark = items.sparkSession
    index = index or key_index(f"{path.rstrip('/')}-keys")
    open_ledger(spark, path, LEDGER)

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.persist()
        try:
            asked = _asked(batch)
            taken = index.rows(session, batch_id, asked)
            if known_keys is not None:
                taken = taken.unionByName(known_keys(session).select("project_id", "key_hash"))
            accepted = ingest_events(batch, _relevant(taken, asked)).accepted
            write_batch(as_events(accepted, "key_hash"), path, batch_id)
        finally:
            batch.unpersist()
        stored = read_batch(session, path, LEDGER, batch_id)
        index.add(stored.where(F.col("key_hash").isNotNull()), batch_id)
        index.prune(session, batch_id)

    writer = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _asked(batch: DataFrame) -> DataFrame:
    """The keys that a batch asks for."""
    return batch.where(~is_blank(F.col("idempotency_key"))).select(
        project_id(F.col("project_id")).alias("project_id"), F.sha2("idempotency_key", 256).alias("key_hash")
    )


def _relevant(taken: DataFrame, asked: DataFrame) -> DataFrame:
    """The taken keys that this batch asks about.

    With the batch's keys on every executor the taken ones are only scanned, not shuffled.  A batch above the
    bound is matched by shuffle.
    """
    if asked.limit(BROADCAST_KEYS + 1).count() > BROADCAST_KEYS:
        return taken
    return taken.join(F.broadcast(asked.distinct()), ["project_id", "key_hash"], "left_semi")


def drop_repeats(items: DataFrame) -> DataFrame:
    """Exact form for long histories: the keys live in the state store.

    The state grows with the number of keys for good; run it with the RocksDB
    state store, which keeps it on executor disks.
    """
    return items.withColumn("dedup_key", _key()).dropDuplicates(["project_id", "dedup_key"]).drop("dedup_key")


def _key() -> Column:
    # Without a key an item is told by all it holds; a null batch id or number makes no two alike.
    own = F.concat(F.lit("own:"), F.sha2(F.to_json(F.struct("*")), 256))
    return F.when(is_blank(F.col("idempotency_key")), own).otherwise(F.sha2("idempotency_key", 256))


def drop_recent_repeats(items: DataFrame, delay: str) -> DataFrame:
    """Bounded form: repeats of a key are dropped while its first item is within ``delay``.

    The state is dropped with the watermark; a later repeat comes through.
    """
    return (
        items.withColumn("received_at", F.col("received_at").cast("timestamp"))
        .withWatermark("received_at", delay)
        .withColumn("dedup_key", _key())
        .dropDuplicatesWithinWatermark(["project_id", "dedup_key"])
        .drop("dedup_key")
    )
