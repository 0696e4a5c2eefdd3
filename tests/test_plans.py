"""The shape of the plans: what is pushed down, shuffled, broadcast and split."""

import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import counters, events, funnel, gate, listing, metrics, privacy, retention, traffic
from footfall.plans.fixtures import view
from footfall.plans.registry import QUERIES
from footfall.ranges import resolve_page, resolve_range
from footfall.sources.tables import TableStore

RANGE = resolve_range("2024-01-05", "2024-01-12")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = TableStore(str(tmp_path_factory.mktemp("store")))
    for table, name in (("events", "v_events"), ("sessions", "v_sessions"), ("traffic_metrics", "v_traffic")):
        store.append(view(spark, "/root/testdata/sf0.001", name), table)
    return store


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_query_multiplies_rows(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def scans(text):
    return re.findall(r"FileScan parquet \[[^\n]*", text)


def test_scans_are_pruned(spark, store):
    ev, se, tm = (store.read(spark, t) for t in ("events", "sessions", "traffic_metrics"))
    cases = {
        "funnel": (funnel.funnel(ev, "demo", RANGE, "signup,view"), ["event_type", "created_at"], {"properties", "session_id"}),
        "retention": (retention.retention(ev, "demo", RANGE, "signup", "view"), ["event_type", "created_at"], {"properties", "event_id"}),
        "top": (metrics.top_events(ev, "demo", RANGE), ["created_at"], {"user_id", "device_id", "properties"}),
        "trends": (metrics.trends(se, ev, "demo", RANGE), [], {"user_id", "properties"}),
        "summary": (traffic.traffic_summary(tm, "demo", RANGE), ["metric_type", "created_at"], {"page_path", "user_id"}),
        "list": (listing.list_events(ev, "demo", RANGE, resolve_page(), user_id="u1"), ["user_id", "created_at"], set()),
    }
    for name, (df, pushed, unread) in cases.items():
        for scan in scans(plan(df)):
            folders = scan.split("PartitionFilters: [")[1].split("]")[0]
            assert "project_id" in folders and "dt" in folders, (name, scan)
            filters = scan.split("PushedFilters: [")[1].split("]")[0]
            assert all(p in filters for p in pushed), (name, filters)
            read = set(re.findall(r"(\w+):", scan.split("ReadSchema: struct<")[1]))
            assert not read & unread, (name, read)


def test_funnel_shuffles(spark, store):
    text = plan(funnel.funnel(store.read(spark, "events"), "demo", RANGE, "signup,view,purchase,click"))
    hashed = re.findall(r"Exchange hashpartitioning\((\w+)#\d+(?:, (\w+)#)?", text)
    # All steps share the first exchange; the second carries one row per slot.
    assert sorted(hashed) == sorted([("actor", "slot"), ("actor", ""), ("group_value", "")])


def test_first_row_filters_run_before_the_shuffle(spark, small):
    for df in (
        events.ingest_events(view(spark, small, "v_event_items")).accepted,
        privacy.latest_requests(view(spark, small, "v_privacy_submissions")),
    ):
        text = plan(df)
        below = text.split("Exchange hashpartitioning", 1)[1]
        assert "row_number(), 1, Partial" in below


def test_pages_are_top_k(spark, store):
    assert "TakeOrderedAndProject" in plan(listing.list_events(store.read(spark, "events"), "demo", RANGE, resolve_page(3)))


def test_rules_are_broadcast_only_when_small(spark, small, monkeypatch):
    args = view(spark, small, "v_events"), view(spark, small, "v_counters")
    assert "BroadcastHashJoin" in plan(counters.increments(*args))
    want = sorted(map(tuple, counters.increments(*args).collect()))
    monkeypatch.setattr(counters, "BROADCAST_ROWS", 3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = counters.increments(*args)
        assert "SortMergeJoin" in plan(big)
        assert sorted(map(tuple, big.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_hot_device_is_split(spark):
    """A device with most of the requests does not end up in one join task."""
    known = spark.range(50).select(
        F.lit("demo").alias("project_id"), F.format_string("00000000-0000-4000-8000-%012d", "id").alias("device_id"),
        F.lit("k").alias("api_key"), F.lit(False).alias("is_banned"),
    )
    hot = F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(7))
    requests = spark.range(0, 60_000, 1, 8).select(
        F.lit("demo").alias("project_id"), F.lit("k").alias("api_key"),
        F.format_string("00000000-0000-4000-8000-%012d", hot).alias("device_id"),
        F.lit("00000000-0000-4000-8000-000000000001").alias("user_id"),
        F.lit(0).cast("long").alias("request_ms"), F.timestamp_seconds(F.lit(0)).alias("received_at"), F.sha2(F.col("id").cast("string"), 512).alias("body"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        passed = gate.admitted(requests, known).groupBy("device_id").count()
        assert sum(r["count"] for r in passed.collect()) == 60_000
        assert "skew=true" in plan(passed)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
