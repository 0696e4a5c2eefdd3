"""Folds over streams: any order of files within the delay gives the batch answers."""

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from footfall.operators import bans, privacy
from footfall.schemas import struct
from footfall.streaming import folds, in_order
from footfall.streaming.in_order import state_settings, store_stream
from footfall.streaming.ledger import read_ledger

T0 = datetime(2024, 1, 1)
SUBMISSION = "request_id string, project_id string, user_id string, device_id string, request_type string, processor string, contact_email string, requested_at timestamp"
CHANGE = SUBMISSION.replace("requested_at timestamp", "status string, changed_at timestamp")
ATTEMPT = "ip string, seq long, success boolean, attempted_at timestamp"
FAR = T0 + timedelta(days=40)


def person(key):
    return ("demo", key, "d", "EXPORT", "X", f"{key}@example.org")


def land(spark, folder, rows, schema, files):
    """Files in order of time, each with its rows shuffled and some of them early or late by a file."""
    rnd = random.Random(9)
    span = (rows[-1][-1] - rows[0][-1]) / files
    placed = [[] for _ in range(files + 1)]
    for row in rows:
        placed[min(files, int((row[-1] - rows[0][-1]) / span + rnd.random()))].append(row)
    for k, some in enumerate(placed):
        rnd.shuffle(some)
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return span


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def drain(query):
    query.awaitTermination()
    assert query.exception() is None
    return query.recentProgress


@pytest.mark.parametrize("seed", [1])
def test_requests_with_status_changes_equal_the_batch(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows, changes = [], []
    for i in range(500):
        key, at = rnd.choice(["hot", "hot", f"k{rnd.randrange(8)}"]), T0 + timedelta(seconds=rnd.randrange(20_000))
        rows.append((f"r{i:04d}", *person(key), at))
        if rnd.random() < 0.4:
            for status, after in (("SUBMITTED", 0), ("IN_PROGRESS", rnd.choice([0, 1, 200, 599, 900])), ("SUBMITTED", 950)):
                changes.append((f"r{i:04d}", *person(key), status, at + timedelta(seconds=after)))
    rows.sort(key=lambda r: r[-1])
    changes.sort(key=lambda r: r[-1])
    ticks = [(None, *person("clock"), FAR)], [(None, *person("clock"), "SUBMITTED", FAR)]
    span = max(land(spark, f"{tmp_path}/s", rows, SUBMISSION, 5), land(spark, f"{tmp_path}/c", changes, CHANGE, 5))
    spark.createDataFrame(ticks[0], SUBMISSION).write.parquet(f"{tmp_path}/s/999")
    spark.createDataFrame(ticks[1], CHANGE).write.parquet(f"{tmp_path}/c/999")

    delay = 2 * int(span.total_seconds()) + 1
    found = folds.dedup_request_stream(stream_of(spark, f"{tmp_path}/s", SUBMISSION), stream_of(spark, f"{tmp_path}/c", CHANGE), delay, 60)
    progress = drain(store_stream(found, f"{tmp_path}/out", f"{tmp_path}/cp", once=True, partitions=2))
    assert sum(p.numInputRows > 0 for p in progress) >= 3
    assert progress[-1].stateOperators[0].numRowsTotal == 0
    got = read_ledger(spark, f"{tmp_path}/out", found.schema).collect()
    assert not any(r.late for r in got)
    left = {}
    for r in changes:
        if r[-2] != "SUBMITTED":
            left[r[0]] = min(r[-1], left.get(r[0], r[-1]))
    batch = spark.createDataFrame([(*r, left.get(r[0])) for r in rows], SUBMISSION + ", left_submitted_at timestamp")
    want = {r.request_id: r.answered_by for r in privacy.dedup_requests(batch).collect()}
    assert {r.request_id: r.answered_by for r in got} == want and len(got) == len(rows)
    assert 0 < sum(k != v for k, v in want.items()) < len(want)


def test_fold_of_changes_is_the_batch_fold():
    """A change at the moment of its request, before it, and of a request that was never stored."""
    state, answers = None, []
    for at, kind, name in [(0, 0, "a"), (0, 1, "a"), (5, 1, "b"), (6, 0, "a"), (6, 1, "c"), (7, 0, "never"), (8, 1, "d")]:
        state, out = folds.reuse_or_leave(json.loads(json.dumps(state)), at, kind, name)
        if kind == folds.SUBMISSION:
            answers.append(out)
    assert answers == ["a", "b", "b", "b"]
    assert state["early"] == {"a": 6, "never": 7}
    assert folds._reuse_ends(state) == max(7, 5) + folds.REUSE_MICROS


def test_bans_of_shuffled_files_and_late_attempts(spark, tmp_path):
    rnd = random.Random(3)
    rows = sorted(((rnd.choice(["hot", "hot", f"ip{rnd.randrange(12)}"]), i, rnd.random() < 0.1, T0 + timedelta(seconds=rnd.randrange(15_000))) for i in range(700)), key=lambda r: (r[-1], r[1]))
    span = land(spark, f"{tmp_path}/a", rows, ATTEMPT, 5)
    # After the clock has moved on: a row within the grace is reported, an older one is Spark's to count.
    spark.createDataFrame([("clock", 0, None, FAR)], ATTEMPT).write.parquet(f"{tmp_path}/a/900")
    delay = 2 * int(span.total_seconds()) + 1
    for k, late in enumerate((FAR - timedelta(seconds=delay + 100), FAR - timedelta(seconds=delay + 5000))):
        spark.createDataFrame([("hot", 900 + k, False, late), ("clock", 1, None, FAR)], ATTEMPT).coalesce(1).write.parquet(f"{tmp_path}/a/91{k}")

    found = folds.ban_window_stream(stream_of(spark, f"{tmp_path}/a", ATTEMPT), delay, 1000)
    progress = drain(store_stream(found, f"{tmp_path}/out", f"{tmp_path}/cp", once=True, partitions=2))
    assert progress[-1].stateOperators[0].numRowsTotal == 0
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 1
    got = read_ledger(spark, f"{tmp_path}/out", found.schema)
    assert [(r.ip, r.seq, r.banned_from) for r in got.where("late").collect()] == [("hot", 900, None)]
    want = bans.ban_windows(spark.createDataFrame(rows, ATTEMPT))
    assert want.count() > 10
    assert sorted(got.where("not late").select(want.columns).collect()) == sorted(want.collect())


class Counted:
    """One key's state in memory, with the number of rows that were stored; lists and slices alike."""

    def __init__(self):
        self.written, self.timers = 0, []

    def registerTimer(self, at):
        self.timers.append(at)

    def getValueState(self, name, schema):
        return Cell(self)

    def getListState(self, name, schema):
        return Cell(self, rows=True)

    def getMapState(self, name, key, schema):
        return Cell(self)


class Cell:
    def __init__(self, owner, rows=False):
        self.owner, self.rows, self.value, self.parts = owner, rows, None, {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def put(self, rows):
        self.owner.written += len(rows)
        self.value = list(rows)

    def appendList(self, rows):
        self.put([*(self.value or []), *rows])
        self.owner.written -= len(self.value) - len(rows)

    def getValue(self, key):
        return self.parts.get(key)

    def updateValue(self, key, value):
        self.owner.written += len(json.loads(value[0])[0])
        self.parts[key] = value

    def removeKey(self, key):
        del self.parts[key]


class Clock:
    now = 0

    def getCurrentWatermarkInMs(self):
        return self.now


def test_waiting_rows_are_not_rewritten_at_every_wake_up(monkeypatch):
    """A hot key with a long delay: 60 batches, each row waits through 20 of them."""
    rnd, clock, handle = random.Random(5), Clock(), Counted()
    processor = in_order.InOrder(folds._count, folds._count_ends, ["ip"], struct("at_us bigint, seq bigint, success boolean"), T.LongType(), 0)
    monkeypatch.setattr(in_order, "SLICE_ROWS", 50, raising=False)
    processor.init(handle)
    got, rows, most = [], [], 0
    for batch in range(81):
        new = [((batch * 10_000 + rnd.randrange(1, 10_000)) * 1000, batch * 1000 + i, rnd.random() < 0.1) for i in range(300)] if batch < 60 else []
        rows += new
        for start in range(0, len(new), 100):
            frame = pd.DataFrame(new[start : start + 100], columns=["at_us", "seq", "success"]).assign(ip="a", clock=False)
            got += list(processor.handleInputRows(("a",), iter([frame]), clock))
        for _ in [t for t in handle.timers if t <= clock.now]:
            got += list(processor.handleExpiredTimer(("a",), clock, None))
        handle.timers = [t for t in handle.timers if t > clock.now]
        clock.now = max(0, (batch - 19) * 10_000)
    got = pd.concat(got)
    assert not got["late"].any() and got[["at_us", "seq"]].values.tolist() == [[at, seq] for at, seq, _ in sorted(rows)]
    state, want = None, []
    for row in sorted(rows):
        state, out = folds._count(state, *row)
        want.append(out)
    assert [None if x is None else int(x) for x in got["output"]] == want
    assert handle.written <= 3 * len(rows)
    assert processor.index.get() is None and not processor.slices.parts


def test_changes_of_unseen_requests_leave_in_order_of_time():
    """What waits is the same as if all of it were gone through for every row, which it is not."""
    state, kept = {"open": None, "early": {}}, {}
    rnd = random.Random(2)
    for at in range(0, 5 * folds.REUSE_MICROS, folds.REUSE_MICROS // 400):
        name = f"r{rnd.randrange(2000)}"
        kept = {k: v for k, v in kept.items() if v >= at - folds.REUSE_MICROS}
        kept[name] = min(at, kept.get(name, at))
        state, _ = folds.reuse_or_leave(state, at, folds.CHANGE, name)
        assert state["early"] == kept
    early = state["early"]
    assert list(early.values()) == sorted(early.values())
    again, _ = folds.reuse_or_leave(state, at, folds.CHANGE, "last")
    assert again["early"] is early  # the same mapping goes on: nothing is copied per row


def test_rows_that_land_in_slices_are_made_once(spark, tmp_path):
    from footfall.streaming import jobs

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(number):
        made.add(1)
        return f"key-{number}"

    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("at"), key("id").alias("key"))
    assert jobs.landed_in_slices(rows, "at", f"{tmp_path}/rows", 600, clock=False)[0] == 200
    assert made.value == 200
    parts = [{r.key for r in spark.read.schema(rows.schema).parquet(f"{tmp_path}/rows/{k}").collect()} for k in range(jobs.SLICES + 1)]
    assert set().union(*parts) == {f"key-{i}" for i in range(200)} and sum(map(len, parts)) == 200 and all(parts)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["rows"]


def test_settings_are_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None), spark.conf.get("spark.sql.shuffle.partitions")
    with state_settings(spark, 3):
        assert "RocksDB" in spark.conf.get(name) and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert (spark.conf.get(name, None), spark.conf.get("spark.sql.shuffle.partitions")) == before


def test_traffic_counts_are_observed_while_writing(spark, tmp_path):
    from footfall.sources import landing
    from footfall.streaming import traffic

    device = "00000000-0000-4000-8000-00000000000a"
    item = {"metric_type": "view", "timestamp": 1}
    lines = [
        [{"batch_id": "b1", "project_id": "demo", "device_id": device, "user_id": "u", "received_at": "2024-01-01T00:00:00Z", "items": [item, {"metric_type": " "}, None]}],
        [{"batch_id": "b2", "project_id": "demo", "device_id": device, "user_id": "u", "received_at": "2024-01-01T00:00:00Z", "items": []}, "broken"],
        [{"batch_id": "b3", "project_id": "demo", "device_id": "x", "user_id": "u", "received_at": "2024-01-01T00:00:00Z", "items": [item, item]}],
    ]
    (tmp_path / "in").mkdir()
    for k, some in enumerate(lines):
        (tmp_path / "in" / f"{k}.json").write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in some))
    requests = landing.stream_requests(spark, "traffic", str(tmp_path / "in"), 1)
    drain(traffic.traffic_stream(requests, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    items = traffic.read_items(spark, str(tmp_path / "out"))
    got = {r.batch_id: (r.received, r.accepted, r.rejected, r.failed) for r in traffic.batch_answers(items).collect()}
    assert got == {"b1": (3, 1, 2, False), "b2": (1, 0, 1, True), None: (1, 0, 1, True), "b3": (2, 0, 2, True)}
    counts = [(r.received, r.accepted, r.rejected) for r in traffic.read_counts(spark, str(tmp_path / "out")).orderBy("batch").collect()]
    assert sorted(counts) == [(2, 0, 2), (2, 0, 2), (3, 1, 2)]
    assert items.where("batch >= 0").count() == sum(c[0] for c in counts)
