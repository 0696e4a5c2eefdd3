"""Traffic ingest from signed clients and from public web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import json as J, web
from footfall.functions.actors import content_id, user_of_device
from footfall.functions.text import (
    landing_checks,
    first_reason, is_blank, is_uuid, longer_than, metric_type, metric_type_too_long, no_metric_type, none_if_blank,
    project_id, strip_ends, trim_to_null,
)
from footfall.operators.events import Ingested


def _enriched(metadata: Column, ip: Column, user_agent: Column, salt: str) -> Column:
    """Metadata object plus the salted address hash and the user agent."""
    members = {"userAgent": none_if_blank(user_agent)}
    if salt.strip():
        hashed = F.sha2(F.concat(F.lit(salt + "|"), ip), 256)
        members = {"ipHash": F.when(~is_blank(ip), hashed), **members}
    return J.with_members(J.wrapped(metadata), members)


def _stored(items: DataFrame, salt: str) -> DataFrame:
    """Items in stored form with a ``reason`` column."""
    received_ms = F.unix_millis(F.col("received_at").cast("timestamp"))
    # The checks read the raw fields where that says the same: a filter on them
    # moves below the projection and would evaluate the cleaned fields again.
    rows = items.withColumn("project_id", project_id(F.col("project_id"))).withColumn(
        "reason",
        first_reason(
            *landing_checks(items),
            (is_blank(F.col("project_id")), "missing_project_id"),
            (no_metric_type(F.col("metric_type")), "missing_metric_type"),
            (~is_uuid(F.col("device_id")), "invalid_device_id"),
            (F.col("session_id").isNotNull() & ~is_uuid(F.col("session_id")), "invalid_session_id"),
            (metric_type_too_long(F.col("metric_type"), 50), "metric_type_too_long"),
            (_too_long("page_path"), "page_path_too_long"),
            (_too_long("referrer"), "referrer_too_long"),
        ),
    )
    rows = rows.select(
        "batch_id",
        "item_no",
        F.lower("device_id").alias("device_id"),
        "user_id",
        F.lower("session_id").alias("session_id"),
        metric_type(F.col("metric_type")).alias("metric_type"),
        trim_to_null(F.col("page_path")).alias("page_path"),
        trim_to_null(F.col("referrer")).alias("referrer"),
        F.when(F.col("timestamp") > 0, F.col("timestamp")).otherwise(received_ms).alias("metric_timestamp"),
        _enriched(F.col("metadata"), F.col("client_ip"), F.col("user_agent"), salt).alias("metadata"),
        "project_id",
        F.col("received_at").alias("created_at"),
        "reason",
    )
    return rows.withColumn(
        "metric_id",
        content_id("tm", F.col("created_at"), *[F.col(c) for c in ("project_id", "device_id", "batch_id", "item_no", "metric_type", "page_path")]),
    )


def _split(rows: DataFrame) -> Ingested:
    return Ingested(rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull()))


def _too_long(column: str) -> Column:
    """Longer than 255 after trimming."""
    raw = F.col(column)
    return (F.length(raw) > 255) & longer_than(strip_ends(raw), 255)


def ingest_signed_traffic(items: DataFrame, salt: str = "") -> Ingested:
    """Accepted and rejected items of gated clients."""
    return _split(checked_signed_traffic(items, salt))


def ingest_public_traffic(items: DataFrame, salt: str = "") -> Ingested:
    """Accepted and rejected items of web pages."""
    return _split(checked_public_traffic(items, salt))


def checked_signed_traffic(items: DataFrame, salt: str = "") -> DataFrame:
    """Items of gated clients; the device and user come from the request.

    One pass for both outcomes: ``reason`` is null for accepted items.
    """
    return _stored(items.withColumn("client_ip", web.client_ip(F.col("forwarded_for"), F.col("remote_addr"))), salt)


def checked_public_traffic(items: DataFrame, salt: str = "") -> DataFrame:
    """Items of web pages; visitor, referrer and bot flag come from the headers.

    Where a bot or a header referrer is noted, metadata that is not an object
    is replaced; elsewhere it is wrapped like that of signed clients.
    """
    bot = web.is_bot(F.col("user_agent"))
    referrer = web.resolved_referrer(F.col("referrer"), F.col("referer_header"))
    noted = F.col("bot") | (F.col("resolved").isNotNull() & ~F.col("resolved").eqNullSafe(F.col("referrer")))
    document = F.when(J.is_object(F.col("metadata")), F.col("metadata")).otherwise(F.lit("{}"))
    notes = J.with_members(document, {"isBot": F.when(F.col("bot"), F.lit(True)), "resolvedReferrer": F.col("resolved")})
    named = (
        items.withColumn("bot", bot)
        .withColumn("resolved", referrer)
        .withColumn("client_ip", web.client_ip(F.col("forwarded_for"), F.col("remote_addr")))
        .withColumn("project_id", F.coalesce(none_if_blank(F.col("header_project_id")), F.col("query_project_id")))
        .withColumn(
            "device_id",
            web.visitor_id(F.col("visitor_cookie"), F.col("batch_id"), F.unix_micros(F.col("received_at").cast("timestamp")), F.col("client_ip"), F.col("user_agent")),
        )
        .withColumn("given_user", strip_ends(F.coalesce(none_if_blank(F.col("header_user_id")), none_if_blank(F.col("query_user_id")))))
        .withColumn("user_id", F.coalesce("given_user", user_of_device(F.col("device_id"))))
        .withColumn("metadata", F.when(noted, notes).otherwise(F.col("metadata")))
        .withColumn("referrer", F.when(noted, F.coalesce("resolved", "referrer")).otherwise(F.col("referrer")))
    )
    return _stored(named, salt)


def masked_access_log(log: DataFrame) -> DataFrame:
    """Access log with the client address resolved and its host part hidden."""
    ip = web.client_ip(F.col("forwarded_for"), F.col("remote_addr"))
    return log.withColumn("client_ip", web.mask_ip(ip)).drop("forwarded_for", "remote_addr")
