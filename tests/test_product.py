"""Funnel and retention against plain models of their definitions."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from footfall.operators import funnel as fn
from footfall.operators.retention import parse_days, retention
from footfall.plans.fixtures import view
from footfall.ranges import resolve_range

DAY0 = datetime(2024, 1, 1)
SCHEMA = "event_id string, device_id string, user_id string, event_type string, created_at timestamp, properties string, project_id string"


def events_of(spark, rows):
    return spark.createDataFrame([(f"e{i:05d}", *row, "demo") for i, row in enumerate(rows)], SCHEMA)


def some_rows(seed, actors=12, count=400, days=3, grain=60):
    rnd = random.Random(seed)
    rows = []
    for _ in range(count):
        user = rnd.choice([f"u{rnd.randrange(actors)}", "", None])
        at = DAY0 + timedelta(seconds=grain * rnd.randrange(days * 86400 // grain), microseconds=rnd.choice([0, 0, 1]))
        props = rnd.choice(['{"g":"a"}', '{"g":"b"}', '{"g":null}', '{"g":" "}', '{"g":{"x":1}}', "{}", None])
        rows.append((f"d{rnd.randrange(3)}", user, rnd.choice("sabc"), at, props))
    return rows


def model_funnel(rows, steps, group):
    per_actor = defaultdict(list)
    for i, (device, user, kind, at, props) in enumerate(rows):
        per_actor[user if user and user.strip() else device].append((at, i, kind, props))
    reached = defaultdict(lambda: [0] * len(steps))
    for found in per_actor.values():
        found.sort(key=lambda r: (r[0], r[1]))
        first = next((r for r in found if r[2] == steps[0]), None)
        if first is None:
            continue
        key, at = group(first[3]), first[0]
        reached[key][0] += 1
        for i, step in enumerate(steps[1:], 1):
            later = [r[0] for r in found if r[2] == step and r[0] >= at]
            if not later:
                break
            at = min(later)
            reached[key][i] += 1
    return {k: v for k, v in reached.items()}


def group_of(props):
    return {None: "all", '{"g":"a"}': "a", '{"g":"b"}': "b", '{"g":null}': "(none)", '{"g":" "}': "(empty)", '{"g":{"x":1}}': '{"x":1}', "{}": "(none)"}[props]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("grain", [60, 3600])
def test_funnel_matches_model(spark, seed, grain):
    rows = some_rows(seed, grain=grain)
    steps = ["s", "a", "b", "c"]
    got = defaultdict(list)
    for r in fn.funnel(events_of(spark, rows), "demo", resolve_range("2024-01-01", "2024-01-03"), steps, "g").collect():
        got[r.group_value].append(r.users)
    assert dict(got) == model_funnel(rows, steps, group_of)


def test_funnel_rates_and_same_instant(spark):
    at = DAY0 + timedelta(hours=1)
    rows = [("d", "u1", "b", at, None), ("d", "u1", "a", at, None), ("d", "u2", "a", at, None), ("d", "u3", "a", at, None), ("d", "u3", "b", at - timedelta(1), None)]
    got = fn.funnel(events_of(spark, rows), "demo", resolve_range("2023-12-01", "2024-01-03"), "a, b,a").collect()
    assert [(r.group_value, r.step, r.event_type, r.users, r.conversion_rate, r.drop_off_rate) for r in got] == [
        ("all", 1, "a", 3, 1.0, 0.0), ("all", 2, "b", 1, 0.3333, 0.6667),
    ]


def test_twelve_steps(spark):
    names = [f"step.{i}" for i in range(12)]
    rows = [("d", "u", n, DAY0 + timedelta(hours=i), None) for i, n in enumerate(names)]
    got = fn.funnel(events_of(spark, rows), "demo", resolve_range("2024-01-01", "2024-01-03"), names).collect()
    assert [r.users for r in got] == [1] * 12


def test_empty_range_has_no_groups(spark):
    assert fn.funnel(events_of(spark, some_rows(1)), "demo", resolve_range("2020-01-01", "2020-01-02"), "s,a").collect() == []


def test_one_day_grouped_example(spark):
    """One project and day of the test tables, counted by hand with another tool."""
    events = view(spark, "/root/testdata/sf0.01", "v_events")
    from pyspark.sql import functions as F

    halves = events.withColumn(
        "properties",
        F.when(F.get_json_object("properties", "$.k").cast("int") < 50, F.lit('{"h":"lo"}')).otherwise(F.lit('{"h":"hi"}')),
    )
    got = fn.funnel(halves, "demo", resolve_range("2024-01-05", "2024-01-05"), "signup,view,purchase", "h").collect()
    assert [(r.group_value, r.users) for r in got] == [("hi", 21), ("hi", 4), ("hi", 1), ("lo", 28), ("lo", 6), ("lo", 2)]


@pytest.mark.parametrize("bad", ["", " , a", "a b", "x" * 101, ",".join(f"s{i}" for i in range(13))])
def test_bad_steps(bad):
    with pytest.raises(ValueError):
        fn.event_names(bad)


def test_days():
    assert parse_days(None) == [1, 7, 30]
    assert parse_days(" 7, 1,7,0,") == [0, 1, 7]
    assert fn.event_names("a, b ,a,,") == ["a", "b"]
    for bad in ("x", "91", "-1", "1,,2", "1_0"):
        with pytest.raises(ValueError):
            parse_days(bad)


def model_retention(rows, days, start, end):
    cohort, back = {}, defaultdict(list)
    limit = end + timedelta(days=max(days) + 1)
    for device, user, kind, at, _ in rows:
        who = user if user and user.strip() else device
        if kind == "s" and start <= at < end:
            cohort[who] = min(at, cohort.get(who, at))
        if kind == "a" and start <= at < limit:
            back[who].append(at)
    kept = [sum(any(t + timedelta(d) <= x < t + timedelta(d + 1) for x in back[w]) for w, t in cohort.items()) for d in days]
    return len(cohort), kept


@pytest.mark.parametrize("seed", range(4))
def test_retention_matches_model(spark, seed):
    rows = some_rows(seed, count=150, days=12, grain=3600)
    rng = resolve_range("2024-01-01", "2024-01-03")
    got = retention(events_of(spark, rows), "demo", rng, "s", "a", "0,1,2,5,9").collect()
    cohort, kept = model_retention(rows, [0, 1, 2, 5, 9], rng.start, rng.end)
    assert [r.retained_users for r in got] == kept and {r.cohort_users for r in got} == {cohort}


def test_retention_example(spark):
    got = retention(view(spark, "/root/testdata/sf0.01", "v_events"), "demo", resolve_range("2024-01-01", "2024-01-02"), "signup", "purchase", "1,7,14").collect()
    assert [(r.cohort_users, r.day, r.retained_users) for r in got] == [(78, 1, 25), (78, 7, 28), (78, 14, 17)]


def test_empty_cohort(spark):
    got = retention(events_of(spark, some_rows(1)), "demo", resolve_range("2020-01-01", "2020-01-02"), "s", "a").collect()
    assert [(r.cohort_users, r.day, r.retained_users, r.retention_rate) for r in got] == [(0, d, 0, 0.0) for d in (1, 7, 30)]
