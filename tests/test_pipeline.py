"""From landed files to answers, in batch and as streams."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall import schemas
from footfall.operators import events, gate, privacy, state, traffic, traffic_ingest
from footfall.ranges import resolve_range
from footfall.sources import landing
from footfall.sources.tables import TableStore
from footfall.streaming import append, ingest as stream_ingest

DEV = "00000000-0000-4000-8000-00000000000a"
USER = "00000000-0000-4000-8000-000000000001"
MS = 1704067200000
RANGE = resolve_range("2024-01-01", "2024-01-02")


def write(path, *records):
    path.mkdir(parents=True, exist_ok=True)
    for number, record in enumerate(records):
        file = path / f"{number:03d}.json"
        file.write_text(json.dumps(record) + "\n")
        os.utime(file, (1_700_000_000 + number,) * 2)
    return str(path)


def signed(batch, **more):
    return {
        "batch_id": batch, "project_id": "demo", "api_key": "k", "device_id": DEV, "user_id": USER, "request_ms": MS,
        "received_at": "2024-01-01T00:00:00Z", "remote_addr": "1.2.3.4", "user_agent": "Mozilla", **more,
    }


@pytest.fixture
def devices(spark, tmp_path):
    path = write(
        tmp_path / "devices",
        {"seq": 1, "project_id": "demo", "device_id": DEV.upper(), "api_key": "old", "received_at": "2023-12-01T00:00:00Z", "os_version": "x" * 51},
        {"seq": 2, "project_id": "demo", "device_id": DEV.upper(), "api_key": "k0", "received_at": "2023-12-02T00:00:00Z"},
        {"seq": 3, "project_id": "demo", "device_id": DEV, "api_key": "k", "received_at": "2023-12-03T00:00:00Z"},
    )
    return state.fold_devices(landing.read_requests(spark, "devices", path))


def traffic_requests(tmp_path):
    view = {"metric_type": "pageView", "page_path": "/a", "metadata": {"x": 1}}
    return write(
        tmp_path / "traffic",
        signed("b1", items=[view, {"metric_type": "tap"}, {"metric_type": " "}]),
        signed("b2", api_key="k0", items=[view]),
        signed("b3", request_ms=MS - 10**6, items=[view]),
        signed("b4", items=[view, {**view, "metadata": None}]),
    )


def test_signed_traffic(spark, tmp_path, devices):
    requests = landing.read_requests(spark, "traffic", traffic_requests(tmp_path))
    checked = {r.batch_id: r.reason for r in gate.gate(requests, devices).collect()}
    assert checked == {"b1": None, "b2": "invalid_credentials", "b3": "timestamp_expired", "b4": None}
    items = landing.items_of(gate.admitted(requests, devices))
    accepted, rejected = traffic_ingest.ingest_signed_traffic(items)
    counts = {r.batch_id: (r.received, r.accepted, r.rejected) for r in events.batch_summary(items, accepted).collect()}
    assert counts == {"b1": (3, 2, 1), "b4": (2, 2, 0)} and [r.reason for r in rejected.collect()] == ["missing_metric_type"]
    store = TableStore(str(tmp_path / "store"))
    store.append(accepted, "traffic_metrics")
    got = traffic.traffic_summary(store.read(spark, "traffic_metrics"), "demo", RANGE).head()
    assert (got.page_views, got.visitors) == (3, 1)
    assert set(store.read(spark, "traffic_metrics").columns) == {*schemas.TRAFFIC_METRICS.fieldNames(), "dt"}


def test_signed_traffic_as_a_stream(spark, tmp_path, devices):
    stream = landing.stream_requests(spark, "traffic", traffic_requests(tmp_path), 1)
    accepted, _ = traffic_ingest.ingest_signed_traffic(landing.items_of(stream_ingest.gated_stream(stream, devices)))
    store = TableStore(str(tmp_path / "store"))
    append.append_stream(accepted, store, "traffic_metrics", str(tmp_path / "cp"), once=True).awaitTermination()
    batch = landing.read_requests(spark, "traffic", str(tmp_path / "traffic"))
    want, _ = traffic_ingest.ingest_signed_traffic(landing.items_of(gate.admitted(batch, devices)))
    ids = lambda df: sorted(r.metric_id for r in df.collect())
    assert ids(store.read(spark, "traffic_metrics")) == ids(want)


def test_sessions_and_privacy_from_files(spark, tmp_path):
    base = signed("x")
    uploads = write(
        tmp_path / "sessions",
        *[{**base, "seq": i, "session_id": USER, "session_start_time": f"2024-01-01T0{i}:00:00Z", "screen_count": i, "app_version": v} for i, v in ((1, "1"), (2, "2"), (3, "x" * 51))],
    )
    read = landing.read_requests(spark, "sessions", uploads).withColumn("created_at", F.col("received_at"))
    assert sorted(r.reason or "" for r in state.checked_sessions(read).collect()) == ["", "", "app_version_too_long"]
    row = state.fold_sessions(read).head()
    assert (row.session_start_time, row.screen_count, row.app_version) == (datetime(2024, 1, 1, 1), 2, "2")

    asked = write(
        tmp_path / "privacy",
        {**base, "request_type": "export", "processor": "first_party", "contact_email": " a@example.org "},
        {**base, "request_type": "EXPORT", "processor": "FIRST_PARTY", "contact_email": "a@example.org", "received_at": "2024-01-01T00:05:00Z"},
        {**base, "request_type": "EXPORT", "processor": "ELSEWHERE", "contact_email": "a@example.org"},
        {**base, "request_type": "DELETE", "processor": "FIRST_PARTY", "contact_email": "x" * 256},
    )
    checked = privacy.checked_requests(landing.read_requests(spark, "privacy", asked), ("FIRST_PARTY",))
    assert sorted(r.reason or "" for r in checked.collect()) == ["", "", "contact_email_too_long", "invalid_processor"]
    stored = privacy.stored_requests(checked.where("reason is null"), 2).collect()
    assert [(r.contact_email, r.source, r.status, r.requested_at) for r in stored] == [("a@example.org", "APP_SETTINGS", "SUBMITTED", datetime(2024, 1, 1))]
    assert privacy.request_by_id(checked, "demo", stored[0].request_id, USER).count() == 1
    assert privacy.request_by_id(checked, "demo", stored[0].request_id, "other").count() == 0


def test_notice_changes_the_note_only(spark):
    t0 = datetime(2024, 1, 1)
    base = spark.createDataFrame([("r", t0)], "request_id string, requested_at timestamp")
    log = spark.createDataFrame(
        [("r", "COMPLETED", t0 + timedelta(1), 1, "ann", "done")],
        "request_id string, status string, changed_at timestamp, seq int, operator string, operator_note string",
    )
    sent = spark.createDataFrame([("r", 2, t0 + timedelta(2), " Hello ", " ")], "request_id string, seq int, sent_at timestamp, subject string, operator string")
    row = privacy.request_state(base, log.unionByName(privacy.notices(sent))).head()
    assert (row.status, row.closed_at, row.updated_at, row.operator) == ("COMPLETED", t0 + timedelta(1), t0 + timedelta(2), "ann")
    assert row.operator_note.startswith("[manual-notify] 2024-01-03T00:00:00") and row.operator_note.endswith(" Hello")


def test_keys_in_the_state_store(spark, tmp_path):
    item = {"event_type": "view", "timestamp": 5, "idempotency_key": "x"}
    path = write(tmp_path / "in", signed("b1", items=[item]), signed("b2", items=[item, {**item, "idempotency_key": None}]))
    stream = landing.items_of(landing.stream_requests(spark, "events", path, 1))
    query = stream_ingest.drop_repeats(stream).writeStream.format("memory").queryName("exact").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    assert spark.table("exact").count() == 2


def test_large_batch_matches_keys_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_ingest, "BROADCAST_KEYS", 0)
    item = {"event_type": "view", "timestamp": 5, "idempotency_key": "x"}
    path = write(tmp_path / "in", signed("b1", items=[item]), signed("b2", items=[item, {**item, "idempotency_key": "y"}]))
    stream = landing.items_of(landing.stream_requests(spark, "events", path, 1))
    stream_ingest.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("batch >= 0").count() == 2
