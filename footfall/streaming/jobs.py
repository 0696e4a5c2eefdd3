"""The streams over the test tables, run until the input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall.operators.ordered_fold import SMALL_RUN
from footfall.plans.fixtures import view, view_over
from footfall.ranges import TimeRange
from footfall.schemas import EVENTS
from footfall.session import scratch_path
from footfall.sources.files import remove
from footfall.streaming import counters, folds, in_order, ingest, trends, visitors
from footfall.streaming.counter_store import CounterStore
from footfall.streaming.key_index import key_index
from footfall.streaming.ledger import read_ledger


def source_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The events table as a file stream; it may be one file or a folder."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    # As a glob the path may be a single file; a plain path must be a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def _adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = f"stream_{uuid.uuid4().hex}"
    source_stream(spark, sf_dir).createOrReplaceTempView(source)
    try:
        return view_over(spark, sf_dir, name, source)
    finally:
        spark.catalog.dropTempView(source)


# Micro-batches of the streams that need several.
SLICES = 3


def landed_in_slices(rows: DataFrame, time: str, path: str, spread_s: int, clock: bool = True) -> tuple[int, int]:
    """Land rows as folders in order of time, some up to ``spread_s`` seconds after their turn.

    With ``clock`` a last file has a row without values far ahead, so that event time ends all waiting.
    Returns the number of rows and by how many seconds one may come after a later one: the files of
    a folder are in no order, so that is its whole width beside the spread.
    """
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    low, high, count = rows.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    width = ((high or 0) - (low or 0)) // SLICES + 1
    turn = F.floor((at - (low or 0) + F.pmod(F.hash(*rows.columns), F.lit(spread_s))) * SLICES / ((high or 0) - (low or 0) + 1))
    placed = rows.withColumn("slice", F.greatest(F.lit(0), F.least(F.lit(SLICES), F.coalesce(turn, F.lit(0)))))
    # The rows are made once; a stream takes files by age, so the slices land one after the other.
    whole = f"{path}-placed"
    placed.write.partitionBy("slice").parquet(whole)
    made = rows.sparkSession.read.schema(placed.schema).parquet(whole)
    for k in range(SLICES + 1):
        made.where(F.col("slice") == k).select(*rows.columns).write.parquet(f"{path}/{k}")
    remove(rows.sparkSession, whole)
    if clock:
        far = F.timestamp_seconds(F.lit((high or 0) + 10 * (width + spread_s))).cast(rows.schema[time].dataType).alias(time)
        empty = [far if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        rows.sparkSession.range(1).select(*empty).write.parquet(f"{path}/{SLICES + 1}")
    return count, width + spread_s


def _slices(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The landed slices as a stream of about as many micro-batches."""
    files = len(spark.read.schema(like.schema).parquet(f"{path}/*").inputFiles())
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", -(-files // (SLICES + 1))).parquet(f"{path}/*")


def _state_partitions(spark: SparkSession, rows: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SMALL_RUN)))


def privacy_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions and status changes as two streams, each a little out of order."""
    path, spread = scratch_path(spark, "stream-privacy"), 7200
    submissions, changes = (view(spark, sf_dir, f"v_privacy_{name}") for name in ("submissions", "changes"))
    rows, delay = landed_in_slices(submissions, "requested_at", f"{path}/submissions", spread)
    more, longest = landed_in_slices(changes, "changed_at", f"{path}/changes", spread)
    streams = [_slices(spark, f"{path}/{name}", like) for name, like in (("submissions", submissions), ("changes", changes))]
    found = folds.dedup_request_stream(*streams, delay_s=max(delay, longest) + 60)
    in_order.store_stream(found, f"{path}/ledger", f"{path}/checkpoint", True, _state_partitions(spark, rows + more)).awaitTermination()
    return read_ledger(spark, f"{path}/ledger", found.schema).where(~F.col("late")).select("request_id", "answered_by")


def ban_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, spread = scratch_path(spark, "stream-bans"), 1800
    attempts = view(spark, sf_dir, "v_auth_attempts")
    rows, delay = landed_in_slices(attempts, "attempted_at", f"{path}/attempts", spread)
    found = folds.ban_window_stream(_slices(spark, f"{path}/attempts", attempts), delay_s=delay + 60)
    in_order.store_stream(found, f"{path}/ledger", f"{path}/checkpoint", True, _state_partitions(spark, rows)).awaitTermination()
    bans = read_ledger(spark, f"{path}/ledger", found.schema).where(~F.col("late"))
    return bans.select("ip", "first_failure_at", "banned_from", "banned_until")


def gate_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in micro-batches; devices are banned and let in between them."""
    path = scratch_path(spark, "stream-gate")
    requests = view(spark, sf_dir, "v_event_items").select("batch_id", "item_no", "project_id", "api_key", "device_id", "user_id", "request_ms", "received_at")
    landed_in_slices(requests, "received_at", f"{path}/requests", 7200, clock=False)
    stream = _slices(spark, f"{path}/requests", requests)
    ingest.gate_as_of_stream(stream, lambda session: view(session, sf_dir, "v_device_history"), f"{path}/ledger", f"{path}/checkpoint", once=True).awaitTermination()
    return read_ledger(spark, f"{path}/ledger", T.StructType(requests.schema.fields + [T.StructField("reason", T.StringType())]))


def key_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that a stream of items has taken, from their index."""
    path = scratch_path(spark, "stream-keys")
    items = view(spark, sf_dir, "v_event_items")
    landed_in_slices(items, "received_at", f"{path}/items", 7200, clock=False)
    index = key_index(f"{path}/keys", fan=2)
    query = ingest.ingest_stream(
        _slices(spark, f"{path}/items", items), f"{path}/ledger", f"{path}/checkpoint",
        lambda session: view(session, sf_dir, "v_known_keys"), once=True, index=index,
    )
    query.awaitTermination()
    done = read_ledger(spark, f"{path}/ledger", ingest.LEDGER).agg(F.max("batch")).first()[0]
    return index.rows(spark, (done if done is not None else -1) + 1)


def visitor_stream_result(spark: SparkSession, sf_dir: str, project_id: str, rng: TimeRange) -> DataFrame:
    """Page views and visitors by day, from metrics that arrive out of order."""
    path = scratch_path(spark, "stream-visitors")
    metrics = view(spark, sf_dir, "v_traffic")
    landed_in_slices(metrics, "created_at", f"{path}/metrics", 7 * 86400, clock=False)
    sets = visitors.visitor_sets(f"{path}/sets", fan=2)
    query = visitors.visitor_stream(_slices(spark, f"{path}/metrics", metrics), sets, f"{path}/checkpoint", once=True)
    query.awaitTermination()
    done = query.lastProgress.batchId + 1 if query.lastProgress else 0
    return visitors.traffic_of(spark, sets, done, project_id, rng)


def counter_snapshot_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log landed in batches, with snapshots taken on the way."""
    store = CounterStore(scratch_path(spark, "counter-store"))
    store.create(spark)
    changes = view(spark, sf_dir, "v_counter_changes")
    high = changes.agg(F.max("seq")).first()[0] or 0
    batches = 2 * SLICES
    for k in range(batches):
        low, top = high * k // batches, high * (k + 1) // batches
        store.append(changes.where((F.col("seq") > low if k else F.lit(True)) & (F.col("seq") <= top)), k)
        if k in (SLICES - 1, batches - 2):
            store.compact(spark, k)
            store.prune(spark, k)
    return store.state(spark)


def event_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream-events")
    ingest.ingest_stream(
        _adapted(spark, sf_dir, "v_event_items"), f"{path}/ledger", f"{path}/checkpoint",
        lambda session: view(session, sf_dir, "v_known_keys"), once=True
    ).awaitTermination()
    return read_ledger(spark, f"{path}/ledger", ingest.LEDGER).select(*EVENTS.fieldNames())


def counter_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream-counters")
    counters.count_stream(
        _adapted(spark, sf_dir, "v_events"), lambda session: view(session, sf_dir, "v_counters"), f"{path}/ledger", f"{path}/checkpoint", once=True
    ).awaitTermination()
    return counters.ledger_totals(spark, f"{path}/ledger")


def page_view_stream_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "stream-views")
    trends.page_view_stream(_adapted(spark, sf_dir, "v_traffic"), f"{path}/ledger", f"{path}/checkpoint", once=True).awaitTermination()
    return trends.page_views(spark, f"{path}/ledger")
