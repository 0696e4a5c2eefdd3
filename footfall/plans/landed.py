"""Whole ways of a record: landed as JSON, read, checked, stored, read back for an active project.

The registry of projects is a table of its own: a project without a row there, or one that is
not active, is refused, whatever its tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators import events, privacy, state, traffic_ingest
from footfall.operators.rollups import Rollups
from footfall.plans.fixtures import view
from footfall.ranges import TimeRange
from footfall.session import scratch_path
from footfall.sources import landing
from footfall.sources.tables import TableStore, project_reason, require_active
from footfall.streaming import traffic as stream_traffic

# The file keeps microseconds.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _land(rows: DataFrame, path: str) -> str:
    times = {f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"}
    rows.withColumns(times).write.options(**_JSON).json(path)
    return path


def _read_back(spark: SparkSession, sf_dir: str, rows: DataFrame, table: str, path: str, project_id: str) -> DataFrame:
    store = TableStore(f"{path}/tables")
    store.create(spark)
    store.append(rows, table)
    return store.read(spark, table, require_active(view(spark, sf_dir, "v_projects"), project_id))


def stored_events(spark: SparkSession, sf_dir: str, project_id: str) -> DataFrame:
    """Event requests of one item each, by event type."""
    path = scratch_path(spark, "landed-events")
    posted = F.array(F.struct("event_type", "timestamp", "properties", "session_id", "idempotency_key")).alias("items")
    batch = F.concat_ws("-", "batch_id", "item_no").alias("batch_id")
    outer = ["project_id", "api_key", "device_id", "user_id", "request_ms", "received_at"]
    _land(view(spark, sf_dir, "v_event_items").select(batch, *outer, posted), f"{path}/landed")
    items = landing.items_of(landing.read_requests(spark, "events", f"{path}/landed"))
    accepted = events.ingest_events(items, view(spark, sf_dir, "v_known_keys")).accepted
    stored = _read_back(spark, sf_dir, events.as_events(accepted), "events", path, project_id)
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def event_batch_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of several items and lines that are no records: what each request is answered.

    The lines that are no records are one batch without an id.
    """
    path = scratch_path(spark, "landed-batches")
    item = F.struct("item_no", "event_type", "timestamp", "properties", "session_id", "idempotency_key")
    outer = ["project_id", "api_key", "device_id", "user_id"]
    rows = view(spark, sf_dir, "v_event_items").withColumn("request", F.concat_ws("|", "batch_id", "project_id", "device_id", "user_id"))
    # A request's items come in one record, so its array is as long as the client's post.
    posted = rows.groupBy(F.col("request").alias("batch_id"), *outer).agg(
        F.max("request_ms").alias("request_ms"), F.max("received_at").alias("received_at"), F.array_sort(F.collect_list(item)).alias("items")
    )
    _land(posted, f"{path}/landed")
    broken = rows.where(F.pmod(F.col("request_ms"), F.lit(50)) == 0).select(F.concat(F.lit('{"batch_id": "'), "batch_id", F.lit('", "items": [')).alias("value"))
    broken.write.mode("append").text(f"{path}/landed")
    items = landing.items_of(landing.read_requests(spark, "events", f"{path}/landed"))
    return events.batch_summary(items, events.ingest_events(items, view(spark, sf_dir, "v_known_keys")).accepted)


def stored_sessions(spark: SparkSession, sf_dir: str, project_id: str) -> DataFrame:
    """Session uploads folded to sessions, by first day."""
    path = scratch_path(spark, "landed-sessions")
    _land(view(spark, sf_dir, "v_session_uploads").withColumnRenamed("created_at", "received_at"), f"{path}/landed")
    read = landing.whole_requests(landing.read_requests(spark, "sessions", f"{path}/landed"))
    sessions = state.fold_sessions(read.withColumn("created_at", F.col("received_at")))
    stored = _read_back(spark, sf_dir, sessions, "sessions", path, project_id)
    return stored.groupBy(F.to_date("session_start_time").alias("day")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("event_count").cast("bigint").alias("events"))


_ITEM = ("metric_type", "page_path", "referrer", "timestamp", "session_id", "metadata")


def stored_traffic(spark: SparkSession, sf_dir: str, project_id: str, public: bool, salt: str) -> DataFrame:
    """Traffic requests of signed clients or of public pages, by metric type."""
    kind = "public_traffic" if public else "traffic"
    path = scratch_path(spark, f"landed-{kind}")
    shape = landing.REQUESTS[kind].fieldNames()
    rows = view(spark, sf_dir, "v_traffic_items")
    outer = [c for c in shape if c in rows.columns and c not in _ITEM]
    _land(rows.select(*outer, F.array(F.struct(*_ITEM)).alias("items")), f"{path}/landed")
    items = landing.items_of(landing.read_requests(spark, kind, f"{path}/landed"))
    ingest = traffic_ingest.ingest_public_traffic if public else traffic_ingest.ingest_signed_traffic
    stored = _read_back(spark, sf_dir, ingest(items, salt).accepted, "traffic_metrics", path, project_id)
    return stored.groupBy("metric_type").agg(F.count(F.lit(1)).alias("metrics"), F.count_distinct("device_id").alias("devices"))


def stored_devices(spark: SparkSession, sf_dir: str, project_id: str) -> DataFrame:
    """Registrations folded to devices, by first day and by the system they have now."""
    path = scratch_path(spark, "landed-devices")
    _land(view(spark, sf_dir, "v_device_registrations"), f"{path}/landed")
    read = landing.whole_requests(landing.read_requests(spark, "devices", f"{path}/landed"))
    stored = _read_back(spark, sf_dir, state.fold_devices(read), "devices", path, project_id)
    return stored.groupBy(F.to_date("created_at").alias("day"), "os_version").agg(F.count(F.lit(1)).alias("devices"))


def stored_privacy(spark: SparkSession, sf_dir: str, project_id: str) -> DataFrame:
    """Privacy requests checked, repeats of an open one left out, by kind and processor."""
    path = scratch_path(spark, "landed-privacy")
    _land(view(spark, sf_dir, "v_privacy_items").drop("received_us"), f"{path}/landed")
    read = landing.whole_requests(landing.read_requests(spark, "privacy", f"{path}/landed"))
    good = privacy.checked_requests(read, ("FIRST_PARTY", "POSTHOG")).where(F.col("reason").isNull()).drop("reason")
    made = privacy.stored_requests(good)
    empty = {n: F.lit(None).cast(t) for n, t in (("operator", "string"), ("operator_note", "string"), ("result_payload", "string"), ("processed_at", "timestamp"), ("closed_at", "timestamp"))}
    rows = made.withColumns({**empty, "created_at": F.col("requested_at"), "updated_at": F.col("requested_at")})
    stored = _read_back(spark, sf_dir, rows, "privacy_requests", path, project_id)
    return stored.groupBy("request_type", "processor").agg(F.count(F.lit(1)).alias("requests"))


def refused_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to read a project, by the project asked for and why it is refused; null is let through."""
    asked = project_reason(view(spark, sf_dir, "v_project_reads"), view(spark, sf_dir, "v_projects"))
    return asked.groupBy("project_id", "reason").agg(F.count(F.lit(1)).alias("reads"))


def rolled_overview(spark: SparkSession, sf_dir: str, project_id: str, rng: TimeRange) -> DataFrame:
    """The overview from partials that were refreshed before and after later days arrived."""
    path = scratch_path(spark, "rollups")
    store = TableStore(f"{path}/tables")
    store.create(spark)
    rollups = Rollups(store, f"{path}/rollups")
    rollups.create(spark)
    store.append(view(spark, sf_dir, "v_devices").withColumn("secret_key", F.lit(None).cast("string")), "devices")
    store.append(view(spark, sf_dir, "v_sessions"), "sessions")
    rows, later = view(spark, sf_dir, "v_events"), F.col("created_at") >= F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    for part in (~later, later):
        store.append(rows.where(part), "events")
        rollups.refresh(spark)
    return rollups.overview(spark, project_id, rng)


def traffic_stream_answers(spark: SparkSession, sf_dir: str, salt: str) -> DataFrame:
    """Signed traffic of several items a request, with lines that are no records, as a stream; the answers by request."""
    path = scratch_path(spark, "stream-traffic")
    rows = view(spark, sf_dir, "v_traffic_items")
    outer = ["batch_id", "project_id", "device_id", "user_id"]
    posted = rows.groupBy(*outer).agg(F.max("received_at").alias("received_at"), F.array_sort(F.collect_list(F.struct("item_no", *_ITEM))).alias("items"))
    _land(posted.withColumn("batch_id", F.concat_ws("|", *outer)), f"{path}/landed")
    broken = rows.where(F.col("item_no") == 7).select(F.concat(F.lit("no record of "), "batch_id").alias("value"))
    broken.write.mode("append").text(f"{path}/landed")
    requests = landing.stream_requests(spark, "traffic", f"{path}/landed", 2)
    stream_traffic.traffic_stream(requests, f"{path}/ledger", f"{path}/checkpoint", salt, once=True).awaitTermination()
    return stream_traffic.batch_answers(stream_traffic.read_items(spark, f"{path}/ledger"))
