"""Schemas of the stored tables and of the landed request records.

Times are UTC.  Free-form attributes stay JSON text: the keys are the users'
own, so a fixed struct would lose some and a map would lose nesting.
"""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def struct(spec: str, items: str | None = None) -> T.StructType:
    """Schema from ``name kind`` pairs, with an array of structs as ``items`` if given.

    Unlike a DDL text it needs no running session.
    """
    pairs = [part.split() for part in spec.split(",") if part.strip()]
    out = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])
    return out if items is None else out.add("items", T.ArrayType(struct(items)))


DEVICES = struct(
    "device_id string, api_key string, secret_key string, device_model string, os_version string,"
    "app_version string, project_id string, is_banned boolean, ban_reason string,"
    "created_at timestamp, last_active_at timestamp"
)
EVENTS = struct(
    "event_id string, device_id string, user_id string, session_id string, event_type string,"
    "event_timestamp bigint, properties string, project_id string, created_at timestamp"
)
SESSIONS = struct(
    "session_id string, device_id string, user_id string, session_start_time timestamp,"
    "session_duration_ms bigint, device_model string, os_version string, app_version string,"
    "build_number string, screen_count int, event_count int, project_id string, created_at timestamp"
)
TRAFFIC_METRICS = struct(
    "metric_id string, device_id string, user_id string, session_id string, metric_type string,"
    "page_path string, referrer string, metric_timestamp bigint, metadata string,"
    "project_id string, created_at timestamp"
)
COUNTERS = struct(
    "counter_key string, counter_value bigint, display_name string, unit string, event_trigger string,"
    "is_public boolean, description string, project_id string, created_at timestamp, updated_at timestamp"
)
PRIVACY_REQUESTS = struct(
    "request_id string, project_id string, user_id string, device_id string, request_type string,"
    "processor string, source string, status string, contact_email string, requester_note string,"
    "operator string, operator_note string, result_payload string, metadata string,"
    "requested_at timestamp, processed_at timestamp, closed_at timestamp,"
    "created_at timestamp, updated_at timestamp"
)
IDEMPOTENCY_KEYS = struct("project_id string, key_hash string, event_id string, created_at timestamp")
PROJECTS = struct(
    "project_id string, project_name string, table_prefix string, is_active boolean,"
    "created_at timestamp, updated_at timestamp"
)

#: Tables of one project, by base name.
PROJECT_TABLES = {
    "devices": DEVICES,
    "events": EVENTS,
    "sessions": SESSIONS,
    "traffic_metrics": TRAFFIC_METRICS,
    "counters": COUNTERS,
    "privacy_requests": PRIVACY_REQUESTS,
    "idempotency_keys": IDEMPOTENCY_KEYS,
}

#: The time column that decides a row's date partition.
PARTITION_TIME = {
    "devices": "created_at",
    "events": "created_at",
    "sessions": "session_start_time",
    "traffic_metrics": "created_at",
    "privacy_requests": "requested_at",
    "idempotency_keys": "created_at",
}

# Landed requests.  One record is one HTTP request; a single post is a batch
# of one item.  Signed requests carry the device credentials as columns.
_SIGNED = (
    "batch_id string, project_id string, api_key string, device_id string, user_id string,"
    "request_ms bigint, received_at timestamp, remote_addr string, forwarded_for string, user_agent string,"
)
EVENT_REQUEST = struct(
    _SIGNED,
    items="event_type string, timestamp bigint, properties string, session_id string, idempotency_key string",
)
_TRAFFIC_ITEM = (
    "metric_type string, page_path string, referrer string, timestamp bigint, session_id string, metadata string"
)
TRAFFIC_REQUEST = struct(_SIGNED, items=_TRAFFIC_ITEM)
PUBLIC_TRAFFIC_REQUEST = struct(
    "batch_id string, header_project_id string, query_project_id string, header_user_id string,"
    "query_user_id string, visitor_cookie string, referer_header string, remote_addr string,"
    "forwarded_for string, user_agent string, received_at timestamp",
    items=_TRAFFIC_ITEM,
)
SESSION_REQUEST = struct(
    "seq bigint, project_id string, api_key string, device_id string, user_id string, request_ms bigint,"
    "received_at timestamp, session_id string, session_start_time timestamp, session_duration_ms bigint,"
    "device_model string, os_version string, app_version string, build_number string,"
    "screen_count int, event_count int"
)
DEVICE_REQUEST = struct(
    "seq bigint, project_id string, device_id string, device_model string, os_version string,"
    "app_version string, api_key string, secret_key string, received_at timestamp"
)
PRIVACY_REQUEST = struct(
    "project_id string, api_key string, device_id string, user_id string, request_ms bigint,"
    "received_at timestamp, request_type string, processor string, source string, contact_email string,"
    "requester_note string, metadata string"
)

REQUESTS = {
    "events": EVENT_REQUEST,
    "traffic": TRAFFIC_REQUEST,
    "public_traffic": PUBLIC_TRAFFIC_REQUEST,
    "sessions": SESSION_REQUEST,
    "devices": DEVICE_REQUEST,
    "privacy": PRIVACY_REQUEST,
}
