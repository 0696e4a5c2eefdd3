"""Time ranges, pages and bucket sizes given by the caller.

All of this is driver-side arithmetic on a handful of literals.  The literals
reach the scan as plain comparisons, so that files and row groups are skipped.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_SPAN = timedelta(days=7)
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 200
EPOCH = datetime(1970, 1, 1)

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_INSTANT = re.compile(r"\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}(:?\d{2})?)", re.IGNORECASE)


@dataclass(frozen=True)
class TimeRange:
    """Half-open range ``[start, end)`` of naive UTC times."""

    start: datetime
    end: datetime

    @property
    def span(self) -> timedelta:
        return self.end - self.start

    def until(self, extra: timedelta) -> "TimeRange":
        return TimeRange(self.start, self.end + extra)


@dataclass(frozen=True)
class Page:
    number: int
    size: int
    #: Time and id of the last row seen; a page after them needs no offset.
    after: tuple[str, str] | None = None

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def _utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _blank(text: str | None) -> bool:
    return text is None or not text.strip()


def _parse(text: str | None, is_end: bool) -> datetime | None:
    if _blank(text):
        return None
    text = text.strip()
    try:
        if _DATE.fullmatch(text):
            day = date.fromisoformat(text)
            # A date given as the end includes that day.
            return datetime(day.year, day.month, day.day) + timedelta(days=1 if is_end else 0)
        if _INSTANT.fullmatch(text):
            return datetime.fromisoformat(text).astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        pass
    raise ValueError(f"not an ISO-8601 instant or yyyy-MM-dd date: {text!r}")


def resolve_range(start: str | None, end: str | None, now: datetime | None = None) -> TimeRange:
    """Range from two optional texts; the last seven days if nothing is given."""
    upper = _parse(end, True) or now or _utc_now()
    lower = _parse(start, False) or upper - DEFAULT_SPAN
    if lower > upper:
        raise ValueError("the start of the range is after its end")
    return TimeRange(lower, upper)


def resolve_summary_range(start: str | None, end: str | None, now: datetime | None = None) -> TimeRange:
    """As ``resolve_range``, but all time up to now if nothing is given."""
    if _blank(start) and _blank(end):
        return TimeRange(EPOCH, now or _utc_now())
    return resolve_range(start, end, now)


def resolve_page(
    number: int | None = None, size: int | None = None, cap: int | None = MAX_PAGE_SIZE, after: tuple[str, str] | None = None
) -> Page:
    """A page by number, or the rows ``after`` a time and id.

    The size is cut to ``cap``, by default that of the service; None lifts it.
    """
    size = size if size and size > 0 else DEFAULT_PAGE_SIZE
    return Page(number if number and number > 0 else 1, size if cap is None else min(size, cap), after)


def comma_list(value: str | list) -> list[str]:
    """Parts of a comma-separated text; empty parts at its end do not count."""
    if not isinstance(value, str):
        return [str(part) for part in value]
    parts = value.split(",")
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def resolve_limit(limit: int | None, default: int, cap: int) -> int:
    """Top-N size: missing or below one means the default."""
    return default if limit is None or limit < 1 else min(limit, cap)


def time_literal(df: DataFrame, column: str, value: datetime) -> Column:
    """A literal of the column's own type, so the filter can be pushed down."""
    return F.lit(value.isoformat(sep=" ")).cast(df.schema[column].dataType)


def within(df: DataFrame, column: str, rng: TimeRange) -> Column:
    return (F.col(column) >= time_literal(df, column, rng.start)) & (
        F.col(column) < time_literal(df, column, rng.end)
    )


def in_project(df: DataFrame, project_id: str, column: str | None = None, rng: TimeRange | None = None) -> DataFrame:
    """Rows of one project, optionally inside a range.

    A date partition column ``dt``, if the table has one, is filtered too so
    that whole folders are skipped.
    """
    out = df.where(F.col("project_id") == clean_project_id(project_id))
    if column is None:
        return out
    out = out.where(within(df, column, rng))
    if "dt" in df.columns:
        last = (rng.end - timedelta(microseconds=1)).date() if rng.end > rng.start else rng.end.date()
        out = out.where(F.col("dt").between(F.lit(rng.start.date()), F.lit(last)))
    return out


def clean_project_id(value: str | None) -> str:
    """Drop blanks and invisible format characters from a project id."""
    kept = (
        c for c in value or "" if not (c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cf"))
    )
    cleaned = "".join(kept)
    if not cleaned:
        raise ValueError("a project id is required")
    return cleaned


@dataclass(frozen=True)
class Granularity:
    """Bucket size of a trend."""

    name: str

    @staticmethod
    def of(text: str | None, allowed: tuple[str, ...], unknown: str | None = None) -> "Granularity":
        """Parse a name; an unknown one is an error unless a stand-in is given."""
        name = "day" if _blank(text) else text.strip().lower()
        name = name[:-1] if name.endswith("s") else name
        if name not in allowed:
            if unknown is None:
                raise ValueError(f"granularity must be one of {', '.join(allowed)}")
            name = unknown
        return Granularity(name)

    def bucket(self, column: str) -> Column:
        return F.date_trunc(self.name, F.col(column))

    def floor(self, value: datetime) -> datetime:
        if self.name == "hour":
            return value.replace(minute=0, second=0, microsecond=0)
        day = value.replace(hour=0, minute=0, second=0, microsecond=0)
        if self.name == "week":
            return day - timedelta(days=day.weekday())
        if self.name == "month":
            return day.replace(day=1)
        if self.name == "year":
            return day.replace(month=1, day=1)
        return day

    def buckets(self, spark: SparkSession, rng: TimeRange) -> DataFrame:
        """One row for every bucket that starts before the end of the range."""
        first = self.floor(rng.start)
        one = spark.range(1, numPartitions=1)
        if first >= rng.end:
            return one.where("id < 0").select(F.lit(None).cast("timestamp").alias("bucket"))
        last = rng.end - timedelta(microseconds=1)
        span = F.sequence(
            F.lit(first.isoformat(sep=" ")).cast("timestamp"),
            F.lit(last.isoformat(sep=" ")).cast("timestamp"),
            F.expr(f"interval 1 {self.name}"),
        )
        return one.select(F.explode(span).alias("bucket"))
