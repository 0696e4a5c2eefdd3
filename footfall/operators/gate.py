"""Gate for signed requests: known device, not banned, clock in step.

``gate`` asks the devices as they are; ``gate_as_of`` asks their history for the moment of each request,
so requests that are read again later get the same answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from footfall.functions.text import first_reason, is_uuid

MAX_SKEW_MS = 300_000


def _probed(requests: DataFrame, max_skew_ms: int) -> DataFrame:
    """Requests with the outcome of the header checks and ``probe``, the device to look for.

    A failed header check nulls the probe: such rows never match.
    """
    skew = F.abs(F.unix_millis(F.col("received_at").cast("timestamp")) - F.col("request_ms"))
    header = first_reason(
        (F.col("api_key").isNull() | F.col("device_id").isNull() | F.col("user_id").isNull() | F.col("request_ms").isNull(), "missing_headers"),
        (~is_uuid(F.col("device_id")), "invalid_device_id"),
        (~is_uuid(F.col("user_id")), "invalid_user_id"),
        (skew > max_skew_ms, "timestamp_expired"),
    )
    checked = requests.withColumn("device_id", F.lower("device_id")).withColumn("header_reason", header)
    return checked.withColumn("probe", F.when(F.col("header_reason").isNull(), F.col("device_id")))


def gate(requests: DataFrame, devices: DataFrame, max_skew_ms: int = MAX_SKEW_MS) -> DataFrame:
    """Requests with a ``reason`` column; null means the request may pass.

    Header checks come first and only what passes them meets the devices.  The
    device side is unique per key, so where one device sends a third of all
    requests its join partition is split at run time.
    """
    known = devices.select(
        "project_id", "device_id", "api_key", F.coalesce("is_banned", F.lit(False)).alias("is_banned")
    )
    joined = _probed(requests, max_skew_ms).join(
        known.withColumnRenamed("device_id", "probe"), ["project_id", "api_key", "probe"], "left"
    )
    return joined.withColumn(
        "reason",
        F.coalesce(
            "header_reason",
            F.when(F.col("is_banned").isNull(), F.lit("invalid_credentials")),
            F.when(F.col("is_banned"), F.lit("device_banned")),
        ),
    ).select(*requests.columns, "reason")


def admitted(requests: DataFrame, devices: DataFrame, max_skew_ms: int = MAX_SKEW_MS) -> DataFrame:
    """Only the requests that may pass."""
    return gate(requests, devices, max_skew_ms).where(F.col("reason").isNull()).drop("reason")


def device_versions(history: DataFrame) -> DataFrame:
    """History rows with ``valid_to``, the time of the next row of the device; null for the last one.

    ``history`` has project_id, device_id, api_key, is_banned and valid_from.  Of rows with one time the
    banned one counts, then the one with the largest key.
    """
    key = ["project_id", "device_id"]
    ordered = history.select(*key, "api_key", F.coalesce("is_banned", F.lit(False)).alias("is_banned"), "valid_from").where(F.col("valid_from").isNotNull())
    single = ordered.groupBy(*key, "valid_from").agg(F.max(F.struct("is_banned", "api_key")).alias("v")).select(*key, "valid_from", "v.is_banned", "v.api_key")
    # One key of two parts: the join on the parts then shuffles anew and its hot partitions can be split.
    device = Window.partitionBy(F.struct(*key)).orderBy("valid_from")
    return single.withColumn("valid_to", F.lead("valid_from").over(device))


def gate_as_of(requests: DataFrame, history: DataFrame, max_skew_ms: int = MAX_SKEW_MS) -> DataFrame:
    """Requests with a ``reason`` by the device's history at the time they were received.

    An equi-join on the device with the version's interval as a condition: at most one version of a
    device holds at a time, so no request is multiplied, and a hot device's requests are
    split at run time.
    """
    known = device_versions(history).withColumnsRenamed({"project_id": "v_project", "device_id": "v_device", "api_key": "v_key"})
    at = F.col("received_at")
    then = (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    joined = _probed(requests, max_skew_ms).join(known, (F.col("project_id") == F.col("v_project")) & (F.col("probe") == F.col("v_device")) & then, "left")
    reason = F.coalesce(
        "header_reason",
        F.when(F.col("v_key").isNull() | (F.col("v_key") != F.col("api_key")), F.lit("invalid_credentials")),
        F.when(F.col("is_banned"), F.lit("device_banned")),
    )
    return joined.withColumn("reason", reason).select(*requests.columns, "reason")
