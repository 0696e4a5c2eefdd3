"""Current state of sessions and devices, folded from append-only uploads.

First and last values are picked by aggregates, which combine on the map side:
a session or device with millions of uploads reaches the shuffle as one row
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions.text import first_reason, is_uuid, longer_than

SESSION_KEPT = ["device_id", "user_id", "session_start_time", "project_id", "created_at"]
SESSION_REPLACED = [
    "session_duration_ms", "screen_count", "event_count", "device_model", "os_version", "app_version", "build_number",
]
DEVICE_REPLACED = ["api_key", "secret_key", "device_model", "os_version", "app_version", "last_active_at"]


def _pick(pick, columns: list[str], by: str) -> Column:
    return pick(F.struct(*columns), F.col(by))


def checked_sessions(uploads: DataFrame) -> DataFrame:
    """Session uploads with a ``reason`` column."""
    return uploads.withColumn(
        "reason",
        first_reason(
            (F.col("session_id").isNull(), "missing_session_id"),
            (~is_uuid(F.col("session_id")), "invalid_session_id"),
            (F.col("session_start_time").isNull(), "missing_session_start_time"),
            (longer_than(F.col("user_id"), 128), "user_id_too_long"),
            *_model_checks("device_model", "os_version", "app_version", "build_number"),
        ),
    )


def checked_registrations(registrations: DataFrame) -> DataFrame:
    """Device registrations with a ``reason`` column."""
    return registrations.withColumn(
        "reason",
        first_reason(
            (~is_uuid(F.col("device_id")), "invalid_device_id"), *_model_checks("device_model", "os_version", "app_version")
        ),
    )


def _model_checks(*columns: str) -> list[tuple[Column, str]]:
    return [(longer_than(F.col(c), 100 if c == "device_model" else 50), f"{c}_too_long") for c in columns]


def _good(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def fold_sessions(uploads: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row per session: identity from its first upload, the rest from its last.

    ``current`` is an earlier result with its ``seq``; it is folded along.
    """
    rows = _good(checked_sessions(uploads))
    rows = rows.select(
        F.lower("session_id").alias("session_id"), "seq", *SESSION_KEPT,
        F.coalesce("session_duration_ms", F.lit(0)).cast("bigint").alias("session_duration_ms"),
        F.coalesce("screen_count", F.lit(0)).alias("screen_count"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        *SESSION_REPLACED[3:],
    )
    if current is not None:
        rows = rows.unionByName(current.select(*rows.columns))
    folded = rows.groupBy("session_id").agg(
        _pick(F.min_by, SESSION_KEPT, "seq").alias("kept"),
        _pick(F.max_by, SESSION_REPLACED, "seq").alias("now"),
        F.max("seq").alias("seq"),
    )
    return folded.select("session_id", "kept.*", "now.*", "seq")


def fold_devices(registrations: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One row per project and device; a repeat rotates the key pair."""
    rows = _good(checked_registrations(registrations)).select(
        "project_id", F.lower("device_id").alias("device_id"), "seq",
        F.col("received_at").alias("created_at"), F.col("received_at").alias("last_active_at"),
        "api_key", "secret_key", "device_model", "os_version", "app_version",
        F.lit(None).cast("boolean").alias("is_banned"), F.lit(None).cast("string").alias("ban_reason"),
        F.lit(1).cast("bigint").alias("registrations"),
    )
    if current is not None:
        rows = rows.unionByName(current.select(*rows.columns))
    folded = rows.groupBy("project_id", "device_id").agg(
        F.min_by("created_at", "seq").alias("created_at"),
        _pick(F.max_by, DEVICE_REPLACED, "seq").alias("now"),
        # A ban is set on the stored row, a registration says nothing about it.
        F.max("is_banned").alias("is_banned"),
        F.max("ban_reason").alias("ban_reason"),
        F.sum("registrations").alias("registrations"),
        F.max("seq").alias("seq"),
    )
    return folded.select(
        "project_id", "device_id", "created_at", "now.*",
        F.coalesce("is_banned", F.lit(False)).alias("is_banned"), "ban_reason", "registrations", "seq",
    )


def registration_answers(registrations: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Key and ``is_new`` for every registration.

    Only the first registration of a device that is not stored yet is new.
    """
    rows = _good(checked_registrations(registrations)).withColumn("device_id", F.lower("device_id"))
    key = ["project_id", "device_id"]
    first = rows.groupBy(*key).agg(F.min("seq").alias("first_seq"))
    if current is not None:
        first = first.join(current.select(*key), key, "left_anti")
    return rows.join(first, key, "left").select(
        *key, "seq", "api_key", F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False)).alias("is_new")
    )
