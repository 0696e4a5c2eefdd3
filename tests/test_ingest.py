"""Landed requests, gate, idempotency, stored tables and streams."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.operators import events, gate, listing, traffic_ingest
from footfall.plans.fixtures import view
from footfall.ranges import resolve_page, resolve_range
from footfall.sources import landing, tables
from footfall.streaming import counters as stream_counters, ingest as stream_ingest, trends
from footfall.streaming.ledger import read_ledger

DEV = "00000000-0000-4000-8000-00000000000a"
OTHER = "00000000-0000-4000-8000-00000000000b"
USER = "00000000-0000-4000-8000-000000000001"


def land(path, *requests):
    path.mkdir(parents=True, exist_ok=True)
    for request in requests:
        number = len(list(path.iterdir()))
        file = path / f"{number:03d}.json"
        file.write_text(json.dumps(request) + "\n")
        # A stream takes files by age; files of the same instant have no order.
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return str(path)


def event_request(batch, items, at="2024-01-01T00:00:00Z", **changed):
    return {
        "batch_id": batch, "project_id": " demo", "api_key": "k", "device_id": DEV.upper(), "user_id": USER,
        "request_ms": 1704067200000, "received_at": at, "items": items, **changed,
    }


def item(kind="view", key=None, **changed):
    return {"event_type": kind, "timestamp": 5, "properties": {"k": 1, "n": {"x": [1]}}, "idempotency_key": key, **changed}


def test_landed_events(spark, tmp_path):
    path = land(
        tmp_path / "in",
        event_request("b1", [item(), None, item(" "), item(timestamp=None), item(key="same"), item("click", key="same")]),
        event_request("b2", [item("late", key="same")], at="2024-01-01T00:00:01Z"),
        event_request("b3", []),
    )
    items = landing.items_of(landing.read_requests(spark, "events", path))
    accepted, rejected = events.ingest_events(items)
    got = events.as_events(accepted).orderBy("event_type", "event_id").collect()
    assert [(r.event_type, r.project_id, r.device_id) for r in got] == [("view", "demo", DEV)] * 2
    assert json.loads(got[0].properties) == {"k": 1, "n": {"x": [1]}}
    assert sorted(r.reason for r in rejected.collect()) == ["empty_items", "invalid_timestamp", "missing_event_type", "null_item"]
    summary = {r.batch_id: (r.received, r.accepted, r.rejected, r.failed) for r in events.batch_summary(items, accepted).collect()}
    assert summary == {"b1": (6, 2, 4, False), "b2": (1, 0, 1, True), "b3": (1, 0, 1, True)}
    answers = {(r.batch_id, r.item_no): r.event_id for r in events.duplicate_answers(items, events.new_keys(accepted)).collect()}
    assert len(answers) == 3 and len(set(answers.values())) == 1


def test_no_landed_line_is_lost(spark, tmp_path):
    path = land(tmp_path / "in", event_request("b1", []), event_request("b2", [item()]))
    (tmp_path / "in" / "broken.json").write_text('{"batch_id": "b3", "items": [\n')
    requests = landing.read_requests(spark, "events", path)
    accepted, rejected = events.ingest_events(landing.items_of(requests))
    assert accepted.count() == 1 and sorted(r.reason for r in rejected.collect()) == ["empty_items", "malformed_record"]
    assert landing.whole_requests(requests.cache()).count() == 2 and landing.broken_requests(requests).count() == 1
    requests.unpersist()


def test_items_without_batch_id_stay_apart(spark, tmp_path):
    path = land(tmp_path / "in", *[event_request(None, [item(timestamp=t)]) for t in range(1, 6)])
    assert events.ingest_events(landing.items_of(landing.read_requests(spark, "events", path))).accepted.count() == 5


def test_raw_key_is_hashed_untrimmed(spark, tmp_path):
    path = land(tmp_path / "in", event_request("b1", [item(key="a"), item(key=" a"), item(key="  "), item(key="  ")]))
    items = landing.items_of(landing.read_requests(spark, "events", path))
    assert events.ingest_events(items).accepted.count() == 4


def test_gate(spark):
    devices = spark.createDataFrame([("demo", DEV, "k", False), ("demo", OTHER, "k2", True)], "project_id string, device_id string, api_key string, is_banned boolean")
    at = datetime(2024, 1, 1)
    ms = 1704067200000
    cases = [
        ("ok", "k", DEV.upper(), USER, ms + 300000, None),
        ("old", "k", DEV, USER, ms - 300001, "timestamp_expired"),
        ("key", "x", DEV, USER, ms, "invalid_credentials"),
        ("ban", "k2", OTHER, USER, ms, "device_banned"),
        ("dev", "k", "junk", USER, ms, "invalid_device_id"),
        ("usr1", "k", DEV, USER.replace("-", ""), ms, "invalid_user_id"),
        ("usr2", "k", DEV, "usr_" + USER, ms, "invalid_user_id"),
        ("usr3", "k", DEV, " ", ms, "invalid_user_id"),
        ("usr4", "k", DEV, "a@example.org", ms, "invalid_user_id"),
        ("hdr", None, DEV, USER, ms, "missing_headers"),
    ]
    rows = [(name, "demo", key, dev, user, when, at) for name, key, dev, user, when, _ in cases]
    requests = spark.createDataFrame(rows, "name string, project_id string, api_key string, device_id string, user_id string, request_ms long, received_at timestamp")
    assert {r.name: r.reason for r in gate.gate(requests, devices).collect()} == {c[0]: c[5] for c in cases}
    assert [r.name for r in gate.admitted(requests, devices).collect()] == ["ok"]


def test_public_traffic(spark, tmp_path):
    request = {
        "batch_id": "b", "header_project_id": " ", "query_project_id": "demo", "query_user_id": " u9 ", "visitor_cookie": DEV,
        "referer_header": " https://from.example/ ", "remote_addr": "1.2.3.4", "user_agent": "SomeBot", "received_at": "2024-01-01T00:00:00Z",
        "items": [
            {"metric_type": "PageView", "page_path": " /a ", "metadata": [1], "timestamp": 0},
            {"metric_type": "click", "page_path": "x" * 256},
            {"metric_type": "--"},
        ],
    }
    items = landing.items_of(landing.read_requests(spark, "public_traffic", land(tmp_path / "in", request)))
    accepted, rejected = traffic_ingest.ingest_public_traffic(items, "salt")
    row = accepted.head()
    assert (row.metric_type, row.page_path, row.referrer, row.user_id, row.device_id, row.metric_timestamp) == (
        "page_view", "/a", "https://from.example/", "u9", DEV, 1704067200000,
    )
    meta = json.loads(row.metadata)
    assert meta["isBot"] is True and meta["resolvedReferrer"] == "https://from.example/" and meta["userAgent"] == "SomeBot" and len(meta["ipHash"]) == 64
    assert sorted(r.reason for r in rejected.collect()) == ["missing_metric_type", "page_path_too_long"]
    unsalted = json.loads(traffic_ingest.ingest_public_traffic(items).accepted.head().metadata)
    assert "ipHash" not in unsalted


def test_store(spark, tmp_path):
    store = tables.TableStore(str(tmp_path), "p_")
    store.create(spark)
    assert store.read(spark, "events").count() == 0
    rows = view(spark, "/root/testdata/sf0.001", "v_events").drop("idempotency_key")
    store.append(rows, "events")
    assert store.read(spark, "events").count() == 1000
    rng = resolve_range("2024-01-05", "2024-01-06")
    part = store.read(spark, "events", "demo", "created_at", rng)
    want = rows.where("project_id = 'demo' and created_at >= '2024-01-05' and created_at < '2024-01-07'").count()
    assert part.count() == want > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "dt" in plan.split("PartitionFilters: [")[1].split("]")[0] and "project_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    page = listing.list_events(store.read(spark, "events"), "demo", rng, resolve_page(1, 5), device_id=part.head().device_id)
    assert {r.device_id for r in page.collect()} == {part.head().device_id}


def test_names_and_projects(spark):
    assert tables.table_name("events", "shop_") == "shop_events"
    for base, prefix in (("Events", ""), ("events", "x" * 41), ("events;", "")):
        with pytest.raises(ValueError):
            tables.table_name(base, prefix)
    projects = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "project_id string, is_active boolean")
    assert tables.require_active(projects, " a ") == "a"
    for bad in ("b", "c", "d", "A B", ""):
        with pytest.raises(ValueError):
            tables.require_active(projects, bad)
    rows = spark.createDataFrame([("a",), ("b",), ("z",)], "project_id string")
    assert [r[0] for r in tables.of_active_projects(rows, projects).collect()] == ["a"]


def test_list_filters(spark):
    rng = resolve_range("2024-01-01", "2024-01-31")
    sessions = view(spark, "/root/testdata/sf0.001", "v_sessions")
    one = sessions.where("project_id = 'demo'").head()
    got = listing.list_sessions(sessions, "demo", rng, resolve_page(), session_id=f" {one.session_id.upper()} ").collect()
    assert [(r.session_id, r.total) for r in got] == [(one.session_id, 1)]
    assert listing.list_sessions(sessions, "demo", rng, resolve_page(), user_id="nobody").count() == 0
    with pytest.raises(ValueError):
        listing.list_sessions(sessions, "demo", rng, resolve_page(), device_id="x")
    size = sessions.where("project_id = 'demo'").count()
    pages = [listing.list_sessions(sessions, "demo", rng, resolve_page(n, 200)).collect() for n in range(1, size // 200 + 2)]
    assert len({r.session_id for page in pages for r in page}) == size
    assert {r.total for page in pages for r in page} == {size}


def drain(query):
    query.awaitTermination()


def test_event_stream_equals_batch(spark, tmp_path):
    """Several files, one per micro-batch; a key stays taken across batches and restarts."""
    source = tmp_path / "in"
    land(source, event_request("b1", [item(key="x"), item(key="y"), item()]))
    land(source, event_request("b2", [item(key="x"), item(key="z")], at="2024-01-01T00:00:02Z"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = landing.items_of(landing.stream_requests(spark, "events", str(source), 1))
        drain(stream_ingest.ingest_stream(stream, out, checkpoint, once=True))

    run()
    land(source, event_request("b3", [item(key="y"), item(key="w")], at="2024-01-01T00:00:03Z"))
    run()
    got = {r.event_id for r in read_ledger(spark, out, stream_ingest.LEDGER).collect()}
    batch = landing.items_of(landing.read_requests(spark, "events", str(source)))
    want = {r.event_id for r in events.ingest_events(batch).accepted.collect()}
    assert got == want and len(got) == 5


def test_recent_repeats_are_dropped(spark, tmp_path):
    source = land(tmp_path / "in", event_request("b1", [item(key="x"), item(key="x"), item(), item()]))
    stream = landing.items_of(landing.stream_requests(spark, "events", source))
    query = stream_ingest.drop_recent_repeats(stream, "1 hour").writeStream.format("memory").queryName("recent").trigger(availableNow=True)
    drain(query.option("checkpointLocation", str(tmp_path / "cp")).start())
    assert spark.table("recent").count() == 3


def test_counter_ledger_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    for i in range(3):
        land(source, {"project_id": "demo", "event_type": "buy", "properties": '{"k":1}'})
    rules = spark.createDataFrame([("demo", "c", '{"event_type":"buy","conditions":{"k":"1"}}')], "project_id string, counter_key string, event_trigger string")
    stream = spark.readStream.schema("project_id string, event_type string, properties string").option("maxFilesPerTrigger", 1).json(str(source))
    drain(stream_counters.count_stream(stream, lambda _: rules, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    assert [(r.counter_key, r.hits) for r in stream_counters.ledger_totals(spark, str(tmp_path / "out")).collect()] == [("c", 3)]
    assert stream_counters.ledger_changes(spark, str(tmp_path / "out")).agg(F.sum("amount")).head()[0] == 3


def test_weekly_page_views_start_on_monday(spark, tmp_path):
    rows = [("demo", "page_view", f"2024-01-{d:02d}T12:00:00Z", None) for d in range(1, 15)]
    land(tmp_path / "in", *[dict(zip(("project_id", "metric_type", "created_at", "metadata"), r)) for r in rows])
    stream = spark.readStream.schema("project_id string, metric_type string, created_at timestamp, metadata string").option("maxFilesPerTrigger", 4).json(str(tmp_path / "in"))
    drain(trends.page_view_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "week", once=True))
    got = trends.page_views(spark, str(tmp_path / "out")).orderBy("bucket").collect()
    assert [(r.bucket, r.page_views) for r in got] == [(datetime(2024, 1, 1), 7), (datetime(2024, 1, 8), 7)]


def test_page_views_do_not_depend_on_files(spark, tmp_path):
    """Many files out of time order give the counts of one table."""
    import random

    rows = [("demo", "page_view", f"2024-01-{d:02d}T{h:02d}:00:00Z", None) for d in range(1, 29) for h in range(7)]
    random.Random(1).shuffle(rows)
    names = ("project_id", "metric_type", "created_at", "metadata")
    for i in range(0, len(rows), 14):
        land(tmp_path / "in", *[dict(zip(names, r)) for r in rows[i : i + 14]])
    stream = spark.readStream.schema("project_id string, metric_type string, created_at timestamp, metadata string").option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    drain(trends.page_view_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    assert sorted(r.page_views for r in trends.page_views(spark, str(tmp_path / "out")).collect()) == [7] * 28


def test_ledger_refuses_another_query(spark, tmp_path):
    source = land(tmp_path / "in", event_request("b1", [item(key="x")]))
    out = str(tmp_path / "out")
    for checkpoint in ("cp1", "cp2"):
        stream = landing.items_of(landing.stream_requests(spark, "events", str(source)))
        query = stream_ingest.ingest_stream(stream, out, str(tmp_path / checkpoint), once=True)
        if checkpoint == "cp1":
            drain(query)
        else:
            with pytest.raises(Exception, match="another query"):
                drain(query)
    assert read_ledger(spark, out, stream_ingest.LEDGER).count() == 1


def test_gate_stream_sees_new_devices(spark, tmp_path):
    known = []
    shape = "project_id string, device_id string, api_key string, is_banned boolean"
    request = {"project_id": "demo", "api_key": "k", "device_id": DEV, "user_id": USER, "request_ms": 1704067200000, "received_at": "2024-01-01T00:00:00Z"}
    for i in range(2):
        land(tmp_path / "in", {"batch_id": f"b{i}", **request})
    stream = landing.stream_requests(spark, "events", str(tmp_path / "in"), 1)

    def devices(session):
        known.append(("demo", DEV, "k", False))
        return session.createDataFrame(known[1:], shape)

    drain(stream_ingest.gate_stream(stream, devices, str(tmp_path / "out"), str(tmp_path / "cp"), once=True))
    assert read_ledger(spark, str(tmp_path / "out"), stream.schema).count() == 1
