"""Cohort retention.

A cohort actor is retained on day ``d`` if it returns inside
``[t0 + d * 24 h, t0 + (d + 1) * 24 h)``.  Returns are first reduced to the
earliest and latest of each actor and calendar day.  The days counted from t0
have the same length, so the returns of one calendar day fall on at most two
of them and the two extremes name both: nothing is lost, and a busy actor
shuffles a few rows per day.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from footfall.functions.actors import actor
from footfall.functions.text import is_blank
from footfall.operators.funnel import event_name, rate
from footfall.ranges import TimeRange, comma_list, in_project, time_literal

MAX_DAY = 90
DEFAULT_DAYS = "1,7,30"
DAY_MICROS = 86_400_000_000


def parse_days(days: str | list[int] | None) -> list[int]:
    """Distinct retention days, ascending."""
    if days is None or (isinstance(days, str) and not days.strip()):
        days = DEFAULT_DAYS
    raw = [part.strip() for part in comma_list(days)]
    if not raw or not all(re.fullmatch(r"[+-]?[0-9]+", part) for part in raw):
        raise ValueError(f"malformed days: {days!r}")
    parsed = sorted({int(part) for part in raw})
    if parsed and (parsed[0] < 0 or parsed[-1] > MAX_DAY):
        raise ValueError(f"days must lie in 0..{MAX_DAY}")
    return parsed


def retention(
    events: DataFrame,
    project_id: str,
    rng: TimeRange,
    cohort_event: str,
    return_event: str,
    days: str | list[int] | None = None,
) -> DataFrame:
    """Cohort size, retained users and rate, one row per day."""
    cohort, back, wanted = event_name(cohort_event), event_name(return_event), parse_days(days)
    scan = rng.until(timedelta(days=(wanted[-1] if wanted else 30) + 1))

    at = F.col("at")
    is_cohort = (F.col("event_type") == cohort) & F.col("in_range")
    is_return = F.col("event_type") == back
    per_day = (
        in_project(events, project_id, "created_at", scan)
        .where(F.col("event_type").isin(cohort, back))
        .select(
            actor().alias("actor"),
            "event_type",
            F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
            (F.col("created_at") < time_literal(events, "created_at", rng.end)).alias("in_range"),
        )
        .where(~is_blank(F.col("actor")))
        .groupBy("actor", F.floor(at / DAY_MICROS).alias("utc_day"))
        .agg(
            F.min(F.when(is_cohort, at)).alias("t0"),
            F.min(F.when(is_return, at)).alias("first_back"),
            F.max(F.when(is_return, at)).alias("last_back"),
        )
    )

    def day_of(moment):
        return F.floor((moment - F.col("t0")) / DAY_MICROS).cast("int")

    per_actor = (
        per_day.groupBy("actor")
        .agg(
            F.min("t0").alias("t0"),
            F.collect_list(F.when(F.col("first_back").isNotNull(), F.array("first_back", "last_back"))).alias("back"),
        )
        .where(F.col("t0").isNotNull())
        .select(F.transform(F.flatten("back"), day_of).alias("days"))
    )
    # One row with a count per day: empty days and empty cohorts come out as 0.
    totals = per_actor.agg(
        F.count(F.lit(1)).alias("cohort_users"),
        F.array(
            *[F.coalesce(F.sum(F.array_contains("days", d).cast("bigint")), F.lit(0)) for d in wanted]
        ).alias("retained"),
    )
    pairs = F.arrays_zip(F.array(*[F.lit(d) for d in wanted]).alias("day"), F.col("retained"))
    return totals.select("cohort_users", F.explode(pairs).alias("p")).select(
        "cohort_users",
        F.col("p.day").alias("day"),
        F.col("p.retained").alias("retained_users"),
        rate(
            F.when(F.col("cohort_users") == 0, F.lit(0.0)).otherwise(F.col("p.retained") / F.col("cohort_users"))
        ).alias("retention_rate"),
    )
