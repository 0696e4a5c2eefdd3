"""Filtered, paged lists, newest first."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from footfall.ranges import Page, TimeRange, in_project

_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def _text(value: str | None) -> str | None:
    return value.strip() if value and value.strip() else None


def _uuid(value: str | None, name: str) -> str | None:
    text = _text(value)
    if text is not None and not _UUID.fullmatch(text):
        raise ValueError(f"malformed {name}: {value!r}")
    return text.lower() if text else None


def page_of(df: DataFrame, page: Page | None, time_column: str, id_column: str, columns: list[str]) -> DataFrame:
    """One page and, on each row, the number of rows over all pages.

    The total is a scalar subquery over the same filtered scan; the page is a
    top-k, so nothing is sorted as a whole for the usual first pages.  A page
    ``after`` a row is a top-k at any depth.  A page past the end has no row to
    carry the total; ``page=None`` gives the total as a frame of its own.
    """
    total = df.agg(F.count(F.lit(1)).alias("total"))
    if page is None:
        return total
    rows = df.select(*columns)
    if page.after:
        at, last = F.lit(page.after[0]).cast(df.schema[time_column].dataType), F.lit(page.after[1])
        rows = rows.where((F.col(time_column) <= at) & ((F.col(time_column) < at) | (F.col(id_column) > last)))
    rows = rows.orderBy(F.desc(time_column), F.asc(id_column))
    if not page.after:
        rows = rows.offset(page.offset)
    return rows.limit(page.size).withColumn("total", total.scalar())


def page_by_day(df: DataFrame, page: Page, time_column: str, id_column: str, columns: list[str]) -> DataFrame:
    """The page and the total of ``page_of``, sorting only the days that the page covers.

    One job counts the filtered rows per day, a row for each day of the range, and the counts say
    where the page begins and what the total is.  The page itself reads those days alone (their folders, if the table
    has a date partition) and is a top-k inside them, however deep it is.
    """
    day = F.to_date(time_column)
    counts = sorted(((r.day, r.n) for r in df.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).collect() if r.day), reverse=True)
    total = sum(n for _, n in counts)
    before, skipped, days = 0, 0, []
    for at, n in counts:
        if before + n > page.offset and before < page.offset + page.size:
            skipped = skipped if days else page.offset - before
            days.append(at)
        before += n
    rows = df.where(day.between(F.lit(min(days)), F.lit(max(days)))) if days else df.where(F.lit(False))
    if "dt" in df.columns and days:
        rows = rows.where(F.col("dt").between(F.lit(min(days)), F.lit(max(days))))
    top = rows.select(*columns).orderBy(F.desc(time_column), F.asc(id_column))
    return top.offset(skipped).limit(page.size).withColumn("total", F.lit(total).cast("bigint"))


def _filtered(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def list_events(
    events: DataFrame, project_id: str, rng: TimeRange, page: Page | None,
    event_type: str | None = None, user_id: str | None = None, device_id: str | None = None, by_day: bool = False,
) -> DataFrame:
    """Events of a project; ``by_day`` counts them by day first, for pages deep inside."""
    rows = _filtered(
        in_project(events, project_id, "created_at", rng),
        {"event_type": _text(event_type), "user_id": _text(user_id), "device_id": _uuid(device_id, "device id")},
    )
    columns = ["event_id", "event_type", "event_timestamp", "created_at", "device_id", "user_id", "session_id", "properties"]
    return (page_by_day if by_day and page and not page.after else page_of)(rows, page, "created_at", "event_id", columns)


def list_sessions(
    sessions: DataFrame, project_id: str, rng: TimeRange, page: Page | None,
    session_id: str | None = None, user_id: str | None = None, device_id: str | None = None,
) -> DataFrame:
    rows = _filtered(
        in_project(sessions, project_id, "session_start_time", rng),
        {"session_id": _uuid(session_id, "session id"), "user_id": _text(user_id), "device_id": _uuid(device_id, "device id")},
    )
    columns = [
        "session_id", "device_id", "user_id", "session_start_time", "session_duration_ms", "device_model",
        "os_version", "app_version", "build_number", "screen_count", "event_count", "created_at",
    ]
    return page_of(rows, page, "session_start_time", "session_id", columns)


def list_devices(
    devices: DataFrame, project_id: str, rng: TimeRange, page: Page | None,
    device_id: str | None = None, api_key: str | None = None, is_banned: bool | None = None,
) -> DataFrame:
    rows = _filtered(
        in_project(devices, project_id, "created_at", rng),
        {"device_id": _uuid(device_id, "device id"), "api_key": _text(api_key), "is_banned": is_banned},
    )
    columns = [
        "device_id", "api_key", "device_model", "os_version", "app_version", "is_banned", "ban_reason",
        "created_at", "last_active_at",
    ]
    return page_of(rows, page, "created_at", "device_id", columns)


def list_traffic(
    metrics: DataFrame, project_id: str, rng: TimeRange, page: Page | None, metric_type: str | None = None,
    user_id: str | None = None, device_id: str | None = None, session_id: str | None = None,
) -> DataFrame:
    rows = _filtered(
        in_project(metrics, project_id, "created_at", rng),
        {
            "metric_type": _text(metric_type),
            "user_id": _text(user_id),
            "device_id": _uuid(device_id, "device id"),
            "session_id": _uuid(session_id, "session id"),
        },
    )
    columns = [
        "metric_id", "metric_type", "page_path", "referrer", "metric_timestamp", "created_at",
        "device_id", "user_id", "session_id", "metadata",
    ]
    return page_of(rows, page, "created_at", "metric_id", columns)


def list_privacy(
    requests: DataFrame, project_id: str, rng: TimeRange, page: Page | None, status: str | None = None,
    request_type: str | None = None, processor: str | None = None, user_id: str | None = None,
) -> DataFrame:
    from footfall.operators.privacy import REQUEST_TYPES, STATUSES, code

    rows = _filtered(
        in_project(requests, project_id, "requested_at", rng),
        {
            "status": code(status, STATUSES) if _text(status) else None,
            "request_type": code(request_type, REQUEST_TYPES) if _text(request_type) else None,
            "processor": code(processor) if _text(processor) else None,
            "user_id": _text(user_id),
        },
    )
    columns = [
        "request_id", "user_id", "device_id", "request_type", "processor", "status", "contact_email",
        "requested_at", "processed_at", "closed_at", "operator",
    ]
    return page_of(rows, page, "requested_at", "request_id", columns)
