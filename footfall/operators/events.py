"""Event ingest: checks, idempotency and ids."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions.actors import content_id
from footfall.functions.text import first_reason, is_blank, is_uuid, landing_checks, longer_than, project_id


class Ingested(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def checked_events(items: DataFrame) -> DataFrame:
    """Items with a ``reason`` column; null means the item is good.

    A bad item is dropped on its own, the rest of its batch goes on.
    """
    return items.withColumn("project_id", project_id(F.col("project_id"))).withColumn(
        "reason",
        first_reason(
            *landing_checks(items),
            (is_blank(F.col("project_id")), "missing_project_id"),
            (is_blank(F.col("event_type")), "missing_event_type"),
            (F.col("timestamp").isNull(), "invalid_timestamp"),
            (F.col("session_id").isNotNull() & ~is_uuid(F.col("session_id")), "invalid_session_id"),
            (~is_uuid(F.col("device_id")), "invalid_device_id"),
            (longer_than(F.col("event_type"), 100), "event_type_too_long"),
            (longer_than(F.col("user_id"), 128), "user_id_too_long"),
            (longer_than(F.col("project_id"), 50), "project_id_too_long"),
        ),
    )


def ingest_events(items: DataFrame, known_keys: DataFrame | None = None) -> Ingested:
    """Accepted events, one per idempotency key, and the items that failed a check.

    The first item of a key wins, also over later runs if the stored keys are
    given.  Spark cuts the ``row_number() = 1`` filter down to one row per key
    and map task before the shuffle, so a key repeated by a third of all items
    stays small; the stored keys are matched after that, on unique keys.
    """
    checked = checked_events(items)
    good = checked.where(F.col("reason").isNull()).drop("reason")
    keyed = (
        good.withColumn(
            "event_id",
            content_id(
                "evt", F.col("received_at"),
                *[F.col(c) for c in ("project_id", "device_id", "batch_id", "item_no", "event_type", "timestamp", "idempotency_key")],
            ),
        )
        .withColumn("key_hash", F.when(~is_blank(F.col("idempotency_key")), F.sha2("idempotency_key", 256)))
    )
    first = Window.partitionBy("project_id", "key_hash").orderBy("received_at", "batch_id", "item_no")
    unique = keyed.where(~is_blank(F.col("idempotency_key"))).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    if known_keys is not None:
        unique = unique.join(known_keys.select("project_id", "key_hash"), ["project_id", "key_hash"], "left_anti")
    # An item without a key stands for itself and is not shuffled at all.
    accepted = unique.unionByName(keyed.where(is_blank(F.col("idempotency_key"))))
    return Ingested(accepted, checked.where(F.col("reason").isNotNull()))


def as_events(accepted: DataFrame, *more: str) -> DataFrame:
    """Accepted items in the layout of the events table."""
    return accepted.select(
        "event_id", F.lower("device_id").alias("device_id"), "user_id", F.lower("session_id").alias("session_id"),
        "event_type", F.col("timestamp").alias("event_timestamp"), "properties", "project_id",
        F.col("received_at").alias("created_at"), *more,
    )


def new_keys(accepted: DataFrame) -> DataFrame:
    """Idempotency keys the accepted items have taken."""
    return accepted.where(F.col("key_hash").isNotNull()).select(
        "project_id", "key_hash", "event_id", F.col("received_at").alias("created_at")
    )


def duplicate_answers(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The stored event id for every item that carries a known key."""
    asked = checked_events(items).where(F.col("reason").isNull() & ~is_blank(F.col("idempotency_key")))
    return asked.select(
        "batch_id", "item_no", "project_id", F.sha2("idempotency_key", 256).alias("key_hash")
    ).join(keys.select("project_id", "key_hash", "event_id"), ["project_id", "key_hash"])


def batch_summary(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Received, accepted and rejected items of every batch.

    ``failed`` marks a batch of which nothing could be stored.
    """
    counted = items.select("batch_id", F.lit(1).alias("r"), F.lit(0).alias("a")).unionByName(
        accepted.select("batch_id", F.lit(0).alias("r"), F.lit(1).alias("a"))
    )
    sums = counted.groupBy("batch_id").agg(F.sum("r").alias("received"), F.sum("a").alias("accepted"))
    return sums.select(
        "batch_id", "received", "accepted", (F.col("received") - F.col("accepted")).alias("rejected"),
        (F.col("accepted") == 0).alias("failed"),
    )
