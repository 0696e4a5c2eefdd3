"""Page views, visitors, top pages and top referrers, bots left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.functions.json import not_bot
from footfall.operators.metrics import zero_filled
from footfall.ranges import Granularity, TimeRange, in_project, resolve_limit

PAGE_VIEW = "page_view"
TREND_SIZES = ("hour", "day", "week", "month", "year")


def _human(metrics: DataFrame, project_id: str, rng: TimeRange) -> DataFrame:
    return in_project(metrics, project_id, "created_at", rng).where(not_bot(F.col("metadata")))


def traffic_summary(metrics: DataFrame, project_id: str, rng: TimeRange) -> DataFrame:
    """Page views and the devices that made them."""
    # The type is a filter, not a CASE: it reaches the scan.
    return (
        _human(metrics, project_id, rng)
        .where(F.col("metric_type") == PAGE_VIEW)
        .agg(F.count(F.lit(1)).alias("page_views"), F.count_distinct("device_id").alias("visitors"))
    )


def traffic_trends(metrics: DataFrame, project_id: str, rng: TimeRange, granularity: str | None = None) -> DataFrame:
    """Page views and visitors per bucket, gaps filled with zeros.

    Visitors here are devices with a metric of any type, unlike the summary.
    An unknown granularity counts as day.
    """
    size = Granularity.of(granularity, TREND_SIZES, unknown="day")
    counted = (
        _human(metrics, project_id, rng)
        .groupBy(size.bucket("created_at").alias("bucket"))
        .agg(
            F.count(F.when(F.col("metric_type") == PAGE_VIEW, 1)).alias("page_views"),
            F.count_distinct("device_id").alias("visitors"),
        )
    )
    return zero_filled(metrics.sparkSession, [counted], ["page_views", "visitors"], size, rng)


def _top(metrics: DataFrame, project_id: str, rng: TimeRange, limit: int | None, column: str) -> DataFrame:
    return (
        _human(metrics, project_id, rng)
        .where((F.col("metric_type") == PAGE_VIEW) & F.col(column).isNotNull())
        .groupBy(F.col(column).alias("item_key"))
        .agg(F.count(F.lit(1)).alias("total"))
        .orderBy(F.desc("total"), "item_key")
        .limit(resolve_limit(limit, 10, 100))
    )


def top_pages(metrics: DataFrame, project_id: str, rng: TimeRange, limit: int | None = None) -> DataFrame:
    return _top(metrics, project_id, rng, limit, "page_path")


def top_referrers(metrics: DataFrame, project_id: str, rng: TimeRange, limit: int | None = None) -> DataFrame:
    return _top(metrics, project_id, rng, limit, "referrer")
