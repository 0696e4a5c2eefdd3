"""Overview figures, trends and top events of a project."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.ranges import Granularity, TimeRange, in_project, resolve_limit, within

TREND_SIZES = ("hour", "day")


def overview(devices: DataFrame, sessions: DataFrame, events: DataFrame, project_id: str, rng: TimeRange) -> DataFrame:
    """One row of totals.

    A device counts as active if it registered again inside the range: the
    registration is the only thing that moves ``last_active_at``.
    """
    d = in_project(devices, project_id).agg(
        F.count(F.lit(1)).alias("devices_total"),
        F.count(F.when(within(devices, "last_active_at", rng), 1)).alias("devices_active"),
    )
    s = in_project(sessions, project_id, "session_start_time", rng).agg(
        F.count(F.lit(1)).alias("sessions_total"),
        F.coalesce(F.avg("session_duration_ms"), F.lit(0.0)).alias("avg_ms"),
    )
    e = in_project(events, project_id, "created_at", rng).agg(
        F.count_distinct("user_id").alias("users_active"),
        F.count(F.lit(1)).alias("events_total"),
    )
    return overview_row(d, s, e)


def overview_row(d: DataFrame, s: DataFrame, e: DataFrame) -> DataFrame:
    """The figures of devices, sessions and events, one row each, as one row."""
    # Three one-row results side by side; max picks the only filled value.
    parts = d.unionByName(s, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    return row.select(
        "devices_total",
        "devices_active",
        "users_active",
        "sessions_total",
        "events_total",
        F.floor(F.col("avg_ms") + F.lit(0.5)).cast("bigint").alias("avg_session_duration_ms"),
        F.when(F.col("sessions_total") == 0, F.lit(0.0))
        .otherwise(F.col("events_total") / F.col("sessions_total"))
        .alias("avg_events_per_session"),
    )


def zero_filled(spark, parts: list[DataFrame], values: list[str], size: Granularity, rng: TimeRange) -> DataFrame:
    """Sum of per-bucket counts plus a zero for every bucket of the range.

    The counts are already one row per bucket, so the union holds no more rows
    than the range has buckets, times the parts: one task adds and sorts them.
    """
    out = size.buckets(spark, rng).select("bucket", *[F.lit(0).cast("bigint").alias(v) for v in values])
    for part in parts:
        have = [F.col(v) if v in part.columns else F.lit(0).cast("bigint").alias(v) for v in values]
        out = out.unionByName(part.select(F.col("bucket").cast("timestamp").alias("bucket"), *have))
    summed = out.repartition(1).groupBy("bucket").agg(*[F.sum(v).alias(v) for v in values])
    return summed.sortWithinPartitions("bucket")


def trends(
    sessions: DataFrame, events: DataFrame, project_id: str, rng: TimeRange, granularity: str | None = None
) -> DataFrame:
    """Events and sessions per hour or day, gaps filled with zeros."""
    size = Granularity.of(granularity, TREND_SIZES)
    counted = [
        in_project(df, project_id, column, rng)
        .groupBy(size.bucket(column).alias("bucket"))
        .agg(F.count(F.lit(1)).alias(name))
        for df, column, name in ((events, "created_at", "events"), (sessions, "session_start_time", "sessions"))
    ]
    return zero_filled(events.sparkSession, counted, ["events", "sessions"], size, rng)


def top_events(events: DataFrame, project_id: str, rng: TimeRange, limit: int | None = None) -> DataFrame:
    """Most frequent event types."""
    return (
        in_project(events, project_id, "created_at", rng)
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "event_type")
        .limit(resolve_limit(limit, 10, 50))
    )
