from datetime import datetime, timedelta

import pytest

from footfall.ranges import (
    EPOCH, Granularity, clean_project_id, in_project, resolve_limit, resolve_page, resolve_range, resolve_summary_range,
)

NOW = datetime(2026, 3, 1, 12, 30)


def test_date_end_is_inclusive():
    rng = resolve_range("2026-01-01", "2026-01-02")
    assert (rng.start, rng.end) == (datetime(2026, 1, 1), datetime(2026, 1, 3))


def test_defaults():
    rng = resolve_range(None, " ", NOW)
    assert (rng.start, rng.end) == (NOW - timedelta(days=7), NOW)
    summary = resolve_summary_range(None, None, NOW)
    assert (summary.start, summary.end) == (EPOCH, NOW)
    assert resolve_summary_range("2026-02-28", None, NOW).start == datetime(2026, 2, 28)


def test_instants():
    rng = resolve_range("2026-01-01T02:00:00+02:00", "2026-01-01T10:00:00.5Z")
    assert (rng.start, rng.end) == (datetime(2026, 1, 1), datetime(2026, 1, 1, 10, 0, 0, 500000))


@pytest.mark.parametrize("start,end", [("2026-01-03", "2026-01-01"), ("20260101", None), ("2026-01-01T00:00:00", None), ("x", None)])
def test_malformed(start, end):
    with pytest.raises(ValueError):
        resolve_range(start, end, NOW)


@pytest.mark.parametrize("number,size,want", [(None, None, (1, 50, 0)), (0, 0, (1, 50, 0)), (3, 500, (3, 200, 400)), (2, 10, (2, 10, 10))])
def test_page(number, size, want):
    page = resolve_page(number, size)
    assert (page.number, page.size, page.offset) == want


def test_limit():
    assert [resolve_limit(n, 10, 50) for n in (None, 0, -1, 7, 99)] == [10, 10, 10, 7, 50]


def test_project_id():
    assert clean_project_id(" de​mo \t ") == "demo"
    with pytest.raises(ValueError):
        clean_project_id("  ")


def test_granularity_names():
    assert Granularity.of(None, ("day",)).name == "day"
    assert Granularity.of(" Hours ", ("hour", "day")).name == "hour"
    assert Granularity.of("decade", ("day",), unknown="day").name == "day"
    with pytest.raises(ValueError):
        Granularity.of("week", ("hour", "day"))


@pytest.mark.parametrize(
    "name,start,end,first,count",
    [
        ("hour", "2024-01-01T00:30:00Z", "2024-01-01T03:00:00Z", datetime(2024, 1, 1), 3),
        ("day", "2024-02-28", "2024-03-01", datetime(2024, 2, 28), 3),
        ("week", "2024-01-03", "2024-01-15", datetime(2024, 1, 1), 3),
        ("month", "2024-01-31", "2024-03-01", datetime(2024, 1, 1), 3),
        ("year", "2023-06-01", "2024-01-01", datetime(2023, 1, 1), 2),
        ("day", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", None, 0),
        ("day", "2024-01-01T05:00:00Z", "2024-01-01T05:00:00Z", datetime(2024, 1, 1), 1),
    ],
)
def test_buckets(spark, name, start, end, first, count):
    rows = [r[0] for r in Granularity(name).buckets(spark, resolve_range(start, end)).orderBy("bucket").collect()]
    assert len(rows) == count
    assert not rows or rows[0] == first


def test_partition_dates_are_filtered(spark):
    days = spark.sql("select 'demo' project_id, d dt, cast(d as timestamp) created_at from (select explode(sequence(date'2024-01-01', date'2024-01-09')) d)")
    got = in_project(days, "demo", "created_at", resolve_range("2024-01-03", "2024-01-05"))
    assert sorted(str(r.dt) for r in got.collect()) == ["2024-01-03", "2024-01-04", "2024-01-05"]
