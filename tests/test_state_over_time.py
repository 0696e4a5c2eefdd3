"""Key runs, counter snapshots and the device history: what earlier batches left decides later ones."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import counters, gate
from footfall.streaming import ingest
from footfall.streaming.counter_store import CounterStore
from footfall.streaming.key_index import key_index
from footfall.streaming.ledger import read_ledger

T0 = datetime(2024, 1, 1)
KEYS = "project_id string, key_hash string"


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_every_earlier_batch_once(fan):
    index, most = key_index("x", fan), 0
    for batch in range(2000):
        runs = index.runs_before(batch)
        covered = [b for level, end in runs for b in range(end - fan**level, end)]
        assert covered == list(range(batch))
        most = max(most, len(runs))
    levels = len(key_index("x", fan).runs_before(0)) + next(k for k in range(20) if fan**k >= 2000)
    assert most <= (fan - 1) * levels


def files_opened(df):
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            total += metrics.get("numFiles").get().value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_keys_of_many_batches_open_few_files(spark, tmp_path):
    rnd, index, model, opened = random.Random(1), key_index(str(tmp_path / "k"), fan=3), {}, []
    for batch in range(20):
        keys = {("demo", f"{rnd.getrandbits(32):08x}") for _ in range(40)}
        frame = spark.createDataFrame(sorted(keys), KEYS)
        for _ in range(1 + (batch % 5 == 4)):  # a batch may be handed over twice
            asked = spark.createDataFrame([("demo", k) for b in model.values() for _, k in sorted(b)[:2]] + [("demo", "ffffffff")], KEYS)
            found = {tuple(r) for r in index.rows(spark, batch, asked.where("key_hash like 'a%'")).collect()}
            assert found == {k for b in model.values() for k in b if k[1][0] == "a"} or not any(k[1][0] == "a" for b in model.values() for k in sorted(b)[:2])
            index.add(frame, batch)
            index.prune(spark, batch)
        model[batch] = keys
        opened.append(files_opened(index.rows(spark, batch + 1, spark.createDataFrame([("demo", "a0")], KEYS))))
    assert {tuple(r) for r in index.rows(spark, 20).collect()} == {k for b in model.values() for k in b}
    # One file per run and digit, two runs per level at most: never one per batch.
    assert max(opened) <= 2 * 3 and opened[8] == 1


CHANGES = "project_id string, counter_key string, seq long, op string, amount long, changed_at timestamp, display_name string, unit string, event_trigger string, is_public boolean, description string"


def test_snapshot_with_later_changes_is_the_state_of_all(spark, tmp_path):
    rnd, store, rows = random.Random(2), CounterStore(str(tmp_path / "c")), []
    store.create(spark)
    for seq in range(240):
        op = rnd.choice(["inc", "inc", "inc", "set", "delete"])
        some = lambda *values: rnd.choice([None, *values])
        rows.append(("demo", f"c{rnd.randrange(9)}", seq, op, some(1, 5) if op != "delete" else None, T0 + timedelta(seconds=rnd.randrange(9999)),
                     *((some("a", "b"), some("u"), some("{}"), some(True, False), some("d")) if op == "set" else (None,) * 5)))
    assert store.state(spark).count() == 0
    want = lambda n: sorted(map(tuple, counters.counter_state(spark.createDataFrame(rows[:n], CHANGES)).select("project_id", "counter_key", "counter_value", *counters.TEXT_FIELDS, "created_at", "updated_at").collect()))
    got = lambda: sorted(map(tuple, store.state(spark).select("project_id", "counter_key", "counter_value", *counters.TEXT_FIELDS, "created_at", "updated_at").collect()))
    for batch in range(6):
        part = spark.createDataFrame(rows[40 * batch : 40 * batch + 40], CHANGES)
        store.append(part, batch)
        store.append(part, batch)
        assert got() == want(40 * batch + 40)
        if batch in (1, 2, 4):
            # The last batch may still be repeated, so it is not compacted.
            store.compact(spark, batch - 1)
            store.compact(spark, batch - 1)
            store.prune(spark, batch - 1)
            assert store.version(spark) == batch - 1
            assert got() == want(40 * batch + 40)
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "c" / "changes").glob("query=none/batch=*")}
    assert folders == {-1, 4, 5}
    assert [p.name for p in (tmp_path / "c" / "state").iterdir()] == ["version=3"]


DEV, USER = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-000000000001"
HISTORY = "project_id string, device_id string, api_key string, is_banned boolean, valid_from timestamp"
REQUEST = "batch_id string, project_id string, api_key string, device_id string, user_id string, request_ms long, received_at timestamp"


def request(name, minutes, key="k", device=DEV, project="demo"):
    at = T0 + timedelta(minutes=minutes)
    return (name, project, key, device, USER, int((at - datetime(1970, 1, 1)).total_seconds()) * 1000, at)


def version(minutes, banned=False, key="k", device=DEV, project="demo"):
    return (project, device, key, banned, T0 + timedelta(minutes=minutes))


def test_gate_as_of_edges(spark):
    history = [version(10), version(20, True), version(30), version(30, True, "old"), version(40, None, "new"), version(10, project="other")]
    asked = {"before": (9, "k"), "start": (10, "k"), "open": (19, "k"), "ban": (20, "k"), "tie": (30, "old"), "tie2": (30, "k"), "late": (45, "k"), "new": (45, "new")}
    requests = [request(n, m, k) for n, (m, k) in asked.items()] + [request("none", 15, None), request("odd", 15, device="x"), request("upper", 15, device=DEV.upper())]
    requests.append(request("lost", 15)[:-1] + (None,))
    got = {r.batch_id: r.reason for r in gate.gate_as_of(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(history, HISTORY)).collect()}
    bad = "invalid_credentials"
    assert got == {
        "before": bad, "start": None, "open": None, "ban": "device_banned", "tie": "device_banned", "tie2": bad, "late": bad, "new": None,
        "none": "missing_headers", "odd": "invalid_device_id", "upper": None, "lost": bad,
    }
    empty = gate.gate_as_of(spark.createDataFrame(requests[:2], REQUEST), spark.createDataFrame([], HISTORY))
    assert {r.reason for r in empty.collect()} == {bad}


def test_hot_device_is_split_in_the_as_of_join(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ids = F.when(F.col("id") % 3 == 0, F.lit(DEV)).otherwise(F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0")))
        rows = spark.range(0, 30_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("batch_id"), F.lit("demo").alias("project_id"), F.lit("k").alias("api_key"), ids.alias("device_id"), F.lit(USER).alias("user_id"), F.lit(1704067200000).alias("request_ms"), F.lit(T0).cast("timestamp").alias("received_at"))
        history = rows.select("project_id", "device_id", "api_key").distinct().withColumns({"is_banned": F.lit(False), "valid_from": F.lit(T0 - timedelta(1)).cast("timestamp")})
        out = gate.gate_as_of(rows, history)
        assert out.where("reason is null").count() == 30_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_replay_with_todays_history_answers_as_then(spark, tmp_path):
    for k, rows in enumerate(([request("a", 1), request("b", 2)], [request("c", 12), request("d", 21)], [request("e", 3)])):
        spark.createDataFrame(rows, REQUEST).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    whole = [version(0), version(10, True), version(20)]

    def history(session):
        seen.append(1)
        return session.createDataFrame(whole[: len(seen)], HISTORY)

    def run(name, loader):
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        ingest.gate_as_of_stream(stream, loader, f"{tmp_path}/{name}", f"{tmp_path}/{name}-cp", once=True).awaitTermination()
        schema = spark.createDataFrame([], REQUEST + ", reason string").schema
        return sorted((r.batch_id, r.reason) for r in read_ledger(spark, f"{tmp_path}/{name}", schema).collect())

    replayed = run("replay", lambda session: session.createDataFrame(whole, HISTORY))
    assert replayed == [("a", None), ("b", None), ("c", "device_banned"), ("d", None), ("e", None)]
    first = dict(run("live", history))
    assert {k: first[k] for k in "abe"} == {k: dict(replayed)[k] for k in "abe"} and first["c"] == "device_banned"


def test_pages_by_day_are_the_pages(spark):
    from footfall.operators.listing import page_by_day, page_of
    from footfall.ranges import resolve_page

    rnd = random.Random(5)
    rows = [(f"e{i:03d}", T0 + timedelta(hours=rnd.choice([0, 1, 30, 31, 32, 100]), minutes=rnd.randrange(3))) for i in range(90)]
    frame = spark.createDataFrame(rows, "event_id string, created_at timestamp").withColumn("dt", F.to_date("created_at")).cache()
    columns = ["event_id", "created_at"]
    for number, size in ((1, 7), (3, 7), (13, 7), (14, 7), (2, 40), (1, 90), (1, 200)):
        page = resolve_page(number, size, cap=None)
        want = page_of(frame, page, "created_at", "event_id", columns).collect()
        got = page_by_day(frame, page, "created_at", "event_id", columns)
        assert got.collect() == want, (number, size)
    plan = page_by_day(frame, resolve_page(3, 7), "created_at", "event_id", columns)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert page_by_day(frame.limit(0), resolve_page(1, 5), "created_at", "event_id", columns).count() == 0


def test_visitor_sets_merge_for_any_order_of_batches(spark, tmp_path):
    from footfall.ranges import resolve_range
    from footfall.streaming import visitors

    rnd = random.Random(7)
    rows = [("demo", rnd.choice(["page_view", "click"]), T0 + timedelta(hours=rnd.randrange(72)), rnd.choice([None, '{"isBot":true}', '{"isBot":false}']), rnd.choice([None, *[f"d{k}" for k in range(9)]])) for _ in range(300)]
    schema = "project_id string, metric_type string, created_at timestamp, metadata string, device_id string"
    human = [r for r in rows if r[3] != '{"isBot":true}']
    want = [(sum(r[1] == "page_view" for r in some), len({r[4] for r in some} - {None})) for some in ([r for r in human if r[2].day == d] for d in (1, 2, 3))]
    for name, order in (("a", rows), ("b", rows[::-1])):
        sets = visitors.visitor_sets(str(tmp_path / name), fan=2)
        for batch in range(5):
            part = visitors.devices_of(spark.createDataFrame(order[60 * batch : 60 * batch + 60], schema))
            for _ in range(1 + batch % 2):
                sets.add(part, batch)
                sets.prune(spark, batch)
        found = visitors.traffic_of(spark, sets, 5, "demo", resolve_range("2024-01-01", "2024-01-03"))
        assert [(r.page_views, r.visitors) for r in found.collect()] == want
        assert len(sets.runs_before(5)) == 2
