"""Registered queries: an operator over adapter views, and SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.functions.json import json_text
from footfall.operators import (
    bans, counters, events, funnel, gate, listing, metrics, privacy, retention, state, traffic, traffic_ingest,
)
from footfall.plans import checks, landed
from footfall.plans.fixtures import view
from footfall.ranges import resolve_page, resolve_range, resolve_summary_range
from footfall.session import configure
from footfall.sources.tables import event_types
from footfall.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

PROJECT = "demo"
# All days of the test tables, and a stretch before and after them.
MONTH = resolve_range("2024-01-01", "2024-01-31")
FUNNEL_STEPS = "signup,view,purchase"
SALT = "pepper"

QUERIES: dict[str, Query] = {}


def _plain_times(df: DataFrame) -> DataFrame:
    """Times without zone, as the check engine has them."""
    return df.select(
        *[F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in df.schema]
    )


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_times(fn(configure(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn

    return register


# --- product analytics -------------------------------------------------------


@query("funnel")
def _(spark, sf):
    return funnel.funnel(view(spark, sf, "v_events"), PROJECT, MONTH, FUNNEL_STEPS)


@query("funnel_grouped")
def _(spark, sf):
    return funnel.funnel(view(spark, sf, "v_events"), PROJECT, MONTH, "view,click,purchase,error", "k")


@query("retention")
def _(spark, sf):
    return retention.retention(view(spark, sf, "v_events"), PROJECT, resolve_range("2024-01-01", "2024-01-15"), "signup", "purchase", "0,1,2,3,7,14")


@query("overview")
def _(spark, sf):
    return metrics.overview(view(spark, sf, "v_devices"), view(spark, sf, "v_sessions"), view(spark, sf, "v_events"), PROJECT, MONTH)


@query("overview_rollup")
def _(spark, sf):
    return landed.rolled_overview(spark, sf, PROJECT, MONTH)


@query("metric_trends_day")
def _(spark, sf):
    return metrics.trends(view(spark, sf, "v_sessions"), view(spark, sf, "v_events"), PROJECT, MONTH, "day")


@query("metric_trends_hour")
def _(spark, sf):
    return metrics.trends(view(spark, sf, "v_sessions"), view(spark, sf, "v_events"), PROJECT, MONTH, "hour")


@query("top_events")
def _(spark, sf):
    return metrics.top_events(view(spark, sf, "v_events"), PROJECT, MONTH)


@query("event_types")
def _(spark, sf):
    return event_types(view(spark, sf, "v_events"), PROJECT)


# --- traffic -----------------------------------------------------------------


@query("traffic_summary")
def _(spark, sf):
    return traffic.traffic_summary(view(spark, sf, "v_traffic"), PROJECT, resolve_summary_range(None, None))


def _traffic_trend(size: str) -> None:
    @query(f"traffic_trends_{size}")
    def _(spark, sf):
        return traffic.traffic_trends(view(spark, sf, "v_traffic"), PROJECT, MONTH, size)


for _size in traffic.TREND_SIZES:
    _traffic_trend(_size)


@query("top_pages")
def _(spark, sf):
    return traffic.top_pages(view(spark, sf, "v_traffic"), PROJECT, MONTH)


@query("top_referrers")
def _(spark, sf):
    return traffic.top_referrers(view(spark, sf, "v_traffic"), PROJECT, MONTH, 20)


# --- lists -------------------------------------------------------------------


@query("list_events")
def _(spark, sf):
    return listing.list_events(view(spark, sf, "v_events"), PROJECT, MONTH, resolve_page(2, 100), event_type=" view ")


@query("list_events_after")
def _(spark, sf):
    return listing.list_events(view(spark, sf, "v_events"), PROJECT, MONTH, resolve_page(size=500, cap=None, after=("2024-01-10 00:00:00", "")), event_type="view")


@query("list_events_deep")
def _(spark, sf):
    return listing.list_events(view(spark, sf, "v_events"), PROJECT, MONTH, resolve_page(1000, 2), by_day=True)


@query("list_events_total")
def _(spark, sf):
    return listing.list_events(view(spark, sf, "v_events"), PROJECT, MONTH, None, event_type="view")


@query("list_sessions")
def _(spark, sf):
    return listing.list_sessions(view(spark, sf, "v_sessions"), PROJECT, MONTH, resolve_page(1))


@query("list_devices")
def _(spark, sf):
    return listing.list_devices(view(spark, sf, "v_devices"), PROJECT, MONTH, resolve_page(1, 500), is_banned=False)


@query("list_traffic")
def _(spark, sf):
    return listing.list_traffic(view(spark, sf, "v_traffic"), PROJECT, MONTH, resolve_page(3, 40), metric_type="page_view")


@query("list_privacy")
def _(spark, sf):
    requests = privacy.request_state(view(spark, sf, "v_privacy_submissions"), view(spark, sf, "v_privacy_status_log"))
    return listing.list_privacy(requests, PROJECT, MONTH, resolve_page(1, 75), status="in_progress")


# --- ingest ------------------------------------------------------------------


@query("ingest_events")
def _(spark, sf):
    accepted, _rejected = events.ingest_events(view(spark, sf, "v_event_items"), view(spark, sf, "v_known_keys"))
    return events.as_events(accepted)


@query("pipeline_events")
def _(spark, sf):
    return landed.stored_events(spark, sf, PROJECT)


@query("pipeline_sessions")
def _(spark, sf):
    return landed.stored_sessions(spark, sf, PROJECT)


@query("pipeline_event_batches")
def _(spark, sf):
    return landed.event_batch_answers(spark, sf)


@query("pipeline_traffic")
def _(spark, sf):
    return landed.stored_traffic(spark, sf, PROJECT, False, SALT)


@query("pipeline_public_traffic")
def _(spark, sf):
    return landed.stored_traffic(spark, sf, PROJECT, True, SALT)


@query("pipeline_devices")
def _(spark, sf):
    return landed.stored_devices(spark, sf, PROJECT)


@query("pipeline_privacy")
def _(spark, sf):
    return landed.stored_privacy(spark, sf, PROJECT)


@query("pipeline_refused")
def _(spark, sf):
    return landed.refused_reads(spark, sf)


@query("ingest_event_rejects")
def _(spark, sf):
    _accepted, rejected = events.ingest_events(view(spark, sf, "v_event_items"))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("items"))


@query("ingest_event_batches")
def _(spark, sf):
    items = view(spark, sf, "v_event_items")
    return events.batch_summary(items, events.ingest_events(items, view(spark, sf, "v_known_keys")).accepted)


@query("ingest_duplicate_answers")
def _(spark, sf):
    items = view(spark, sf, "v_event_items")
    return events.duplicate_answers(items, events.new_keys(events.ingest_events(items).accepted))


@query("ingest_gate")
def _(spark, sf):
    requests = view(spark, sf, "v_event_items").select("batch_id", "item_no", "project_id", "api_key", "device_id", "user_id", "request_ms", "received_at")
    return gate.gate(requests, view(spark, sf, "v_devices")).select("batch_id", "item_no", "reason")


@query("ingest_gate_as_of")
def _(spark, sf):
    requests = view(spark, sf, "v_event_items").select("batch_id", "item_no", "project_id", "api_key", "device_id", "user_id", "request_ms", "received_at")
    return gate.gate_as_of(requests, view(spark, sf, "v_device_history")).select("batch_id", "item_no", "reason")


def _stored_traffic(both: DataFrame) -> DataFrame:
    inside = {"ip_hash": "ipHash", "agent": "userAgent", "utm": "utm_source", "bot": "isBot", "resolved": "resolvedReferrer", "data": "data", "n": "n"}
    return both.select(
        "metric_id", "batch_id", "item_no", "device_id", "user_id", "metric_type", "page_path", "referrer",
        "metric_timestamp", "project_id", "created_at", "reason",
        *[json_text(F.col("metadata"), key).alias(name) for name, key in inside.items()],
    )


@query("ingest_traffic_signed")
def _(spark, sf):
    return _stored_traffic(traffic_ingest.checked_signed_traffic(view(spark, sf, "v_traffic_items"), SALT))


@query("ingest_traffic_public")
def _(spark, sf):
    items = view(spark, sf, "v_traffic_items").drop("device_id", "user_id", "project_id")
    return _stored_traffic(traffic_ingest.checked_public_traffic(items, SALT))


@query("mask_access_log")
def _(spark, sf):
    return traffic_ingest.masked_access_log(view(spark, sf, "v_access_log"))


# --- state -------------------------------------------------------------------


@query("session_upsert")
def _(spark, sf):
    return state.fold_sessions(view(spark, sf, "v_session_uploads"))


@query("device_upsert")
def _(spark, sf):
    return state.fold_devices(view(spark, sf, "v_device_registrations"))


@query("device_registrations")
def _(spark, sf):
    return state.registration_answers(view(spark, sf, "v_device_registrations"))


@query("counter_increments")
def _(spark, sf):
    return counters.increments(view(spark, sf, "v_events"), view(spark, sf, "v_counters"))


@query("counter_state")
def _(spark, sf):
    return counters.counter_state(view(spark, sf, "v_counter_changes")).drop("event_trigger", "description", "created_at")


@query("counter_list")
def _(spark, sf):
    found = counters.list_counters(counters.counter_state(view(spark, sf, "v_counter_changes")), PROJECT)
    return found.drop("event_trigger", "description")


@query("counter_public")
def _(spark, sf):
    return counters.public_counters(counters.counter_state(view(spark, sf, "v_counter_changes")), PROJECT, "en-US,en;q=0.8")


# --- privacy and bans --------------------------------------------------------


@query("privacy_submit")
def _(spark, sf):
    return privacy.checked_requests(view(spark, sf, "v_privacy_items"), ("FIRST_PARTY", "POSTHOG")).drop("metadata", "status")


@query("privacy_dedup")
def _(spark, sf):
    return privacy.dedup_requests(view(spark, sf, "v_privacy_submissions")).select("request_id", "answered_by")


@query("privacy_state")
def _(spark, sf):
    return privacy.request_state(view(spark, sf, "v_privacy_submissions"), view(spark, sf, "v_privacy_status_log")).select(
        "request_id", "status", "processed_at", "closed_at", "updated_at", "operator"
    )


@query("privacy_latest")
def _(spark, sf):
    return privacy.latest_requests(view(spark, sf, "v_privacy_submissions")).select("project_id", "user_id", "request_id", "requested_at")


@query("ban_windows")
def _(spark, sf):
    return bans.ban_windows(view(spark, sf, "v_auth_attempts"))


# --- streams, run to the end of the input ------------------------------------


@query("stream_ingest_events")
def _(spark, sf):
    return jobs.event_stream_result(spark, sf)


@query("stream_privacy_dedup")
def _(spark, sf):
    return jobs.privacy_stream_result(spark, sf)


@query("stream_ban_windows")
def _(spark, sf):
    return jobs.ban_stream_result(spark, sf)


@query("stream_traffic_batches")
def _(spark, sf):
    return landed.traffic_stream_answers(spark, sf, SALT)


@query("stream_gate")
def _(spark, sf):
    return jobs.gate_stream_result(spark, sf).select("batch_id", "item_no", "reason")


@query("stream_dedup_keys")
def _(spark, sf):
    return jobs.key_stream_result(spark, sf)


@query("stream_visitors")
def _(spark, sf):
    return jobs.visitor_stream_result(spark, sf, PROJECT, MONTH)


@query("counter_snapshot")
def _(spark, sf):
    return jobs.counter_snapshot_result(spark, sf).drop("event_trigger", "description", "created_at")


@query("stream_counters")
def _(spark, sf):
    return jobs.counter_stream_result(spark, sf)


@query("stream_page_views")
def _(spark, sf):
    return jobs.page_view_stream_result(spark, sf)


ORACLE: dict[str, str] = checks.all_checks()
