"""Order-dependent folds: results must not depend on how the rows are cut."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import bans, privacy
from footfall.plans.fixtures import view

T0 = datetime(2024, 1, 1)


def submissions(spark, rows):
    """Rows of (key, seconds) or (key, seconds, seconds until no longer open)."""
    made = []
    for i, (key, at, *left) in enumerate(rows):
        when = T0 + timedelta(seconds=at)
        made.append((f"r{i:05d}", "demo", key, "d", "EXPORT", "X", f"{key}@example.org", when, when + timedelta(seconds=left[0]) if left and left[0] is not None else None))
    return spark.createDataFrame(
        made,
        "request_id string, project_id string, user_id string, device_id string, request_type string, processor string,"
        "contact_email string, requested_at timestamp, left_submitted_at timestamp",
    )


def model_dedup(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1], i))
    held, answers = {}, {}
    for i in order:
        key, at, *left = rows[i]
        if key in held and at <= held[key][1]:
            answers[i] = held[key][0]
            continue
        until = at + 600
        if left and left[0] is not None:
            until = min(until, at + left[0] - 0.5)
        held[key], answers[i] = (i, until), i
    return {f"r{i:05d}": f"r{j:05d}" for i, j in answers.items()}


def answers(df):
    return {r.request_id: r.answered_by for r in df.collect()}


@pytest.mark.parametrize("runs", [1, 3, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_with_a_hot_key(spark, seed, runs):
    rnd = random.Random(seed)
    # One key holds most rows and never pauses for 600 s, so its chain runs
    # through many cuts.
    rows = [("hot", rnd.randrange(40_000)) for _ in range(900)] + [(f"k{rnd.randrange(30)}", rnd.randrange(40_000)) for _ in range(300)]
    assert answers(privacy.dedup_requests(submissions(spark, rows), runs)) == model_dedup(rows)


def test_dedup_of_a_regular_chain(spark):
    """Evenly spaced rows never forget where the chain began."""
    rows = [("hot", 7 * i) for i in range(1500)]
    assert answers(privacy.dedup_requests(submissions(spark, rows), 12)) == model_dedup(rows)


@pytest.mark.parametrize("kind", ["requests", "failures"])
def test_jobs_do_not_grow_with_the_runs(spark, kind):
    """A regular chain never forgets; the number of jobs is the same for any cut of it."""
    group, counted = spark.sparkContext.statusTracker(), []
    for runs in (4, 16):
        name = f"{kind}-{runs}"
        spark.sparkContext.setJobGroup(name, name)
        if kind == "requests":
            rows = [("hot", 7 * i) for i in range(600)]
            assert answers(privacy.dedup_requests(submissions(spark, rows), runs)) == model_dedup(rows)
        else:
            rows = [("hot", 7 * i, False) for i in range(600)]
            assert windows(bans.ban_windows(attempts(spark, rows), runs)) == model_bans(rows)
        counted.append(len(group.getJobIdsForGroup(name)))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert counted[0] == counted[1]


def test_tables_compose_like_rows():
    """What a table says about any state is what the rows do to it."""
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.randrange(1, 14)
        times = sorted(rnd.randrange(0, 2_000) * 1_000_000 for _ in range(n))
        oks = [rnd.random() < 0.2 for _ in range(n)]
        for state in (None, *[[f, times[0] - rnd.randrange(0, 900) * 1_000_000] for f in range(1, 6)]):
            held = state
            for at, ok in zip(times, oks):
                held, _ = bans.count_failures(held, at, ok)
            assert bans.through_attempts(bans.attempts_table(times, oks), state) == held
        ids = [str(i) for i in range(n)]
        lefts = [None if rnd.random() < 0.6 else t + rnd.randrange(1, 900) * 1_000_000 for t in times]
        for state in (None, ["old", times[0] + rnd.randrange(-600, 600) * 1_000_000]):
            held = state
            for row in zip(ids, times, lefts):
                held, _ = privacy.reuse_open(held, *row)
            assert privacy.through_requests(privacy.requests_table(ids, times, lefts), state) == held


def test_dedup_window_edge_and_status(spark):
    rows = [("a", 0), ("a", 600), ("a", 601), ("b", 0, 100), ("b", 99), ("b", 100), ("b", 650)]
    assert answers(privacy.dedup_requests(submissions(spark, rows), 2)) == model_dedup(rows)


@pytest.mark.parametrize("folder,kept", [("sf0.01", 3930)])
def test_stored_requests_of_the_test_tables(spark, folder, kept):
    assert privacy.stored_requests(view(spark, f"/root/testdata/{folder}", "v_privacy_submissions")).count() == kept


def model_bans(rows):
    held, found = {}, []
    for ip, at, success in sorted(rows):
        state = held.get(ip)
        if state and at - state[1] >= 900:
            state = None
        if state and state[0] >= 5:
            held[ip] = state
            continue
        if success:
            held[ip] = None
            continue
        state = (state[0] + 1, state[1]) if state else (1, at)
        held[ip] = state
        if state[0] == 5:
            found.append((ip, state[1], at, state[1] + 900))
    return sorted(found)


def attempts(spark, rows):
    made = [(ip, i, success, T0 + timedelta(seconds=at)) for i, (ip, at, success) in enumerate(sorted(rows))]
    return spark.createDataFrame(made, "ip string, seq long, success boolean, attempted_at timestamp")


def windows(df):
    sec = lambda c: F.unix_seconds(c).alias(c)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    rows = df.select("ip", sec("first_failure_at"), sec("banned_from"), sec("banned_until")).collect()
    return sorted((r[0], r[1] - base, r[2] - base, r[3] - base) for r in rows)


@pytest.mark.parametrize("runs", [1, 4, 16])
@pytest.mark.parametrize("seed", [1, 2])
def test_bans_with_a_hot_address(spark, seed, runs):
    rnd = random.Random(seed)
    rows = list({("hot", rnd.randrange(20_000), rnd.random() < 0.1) for _ in range(1200)})
    rows += list({(f"ip{rnd.randrange(20)}", rnd.randrange(20_000), rnd.random() < 0.2) for _ in range(400)})
    rows = list({(ip, at): (ip, at, ok) for ip, at, ok in rows}.values())
    assert windows(bans.ban_windows(attempts(spark, rows), runs)) == model_bans(rows)


@pytest.mark.parametrize("folder,count", [("sf0.001", 55), ("sf0.01", 642)])
def test_bans_of_the_test_tables(spark, folder, count):
    assert bans.ban_windows(view(spark, f"/root/testdata/{folder}", "v_auth_attempts")).count() == count
