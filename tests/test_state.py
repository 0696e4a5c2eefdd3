"""Counters, sessions, devices and privacy status."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import counters, privacy, state

T0 = datetime(2024, 1, 1)
DEV = "00000000-0000-4000-8000-00000000000a"


def match(spark, trigger, event_type, properties):
    rules = spark.createDataFrame([("demo", "c", trigger)], "project_id string, counter_key string, event_trigger string")
    events = spark.createDataFrame([("demo", event_type, properties)], "project_id string, event_type string, properties string")
    return counters.increments(events, rules).count() == 1


@pytest.mark.parametrize(
    "trigger,event_type,properties,want",
    [
        ('{"event_type":"checkout"}', "checkout", None, True),
        ('{"event_type":"checkout"}', "refund", None, False),
        ('{"event_type":"e","conditions":{"plan":"gold"}}', "e", '{"plan":"gold"}', True),
        ('{"event_type":"e","conditions":{"plan":"gold"}}', "e", '{"plan":"tin"}', False),
        ('{"event_type":"e","conditions":{"plan":"gold"}}', "e", '{"size":1}', False),
        ('{"event_type":"e","conditions":{"plan":"gold"}}', "e", None, False),
        ('{"event_type":"e","conditions":{}}', "e", None, False),
        ('{"event_type":"e","conditions":{}}', "e", "{}", True),
        ('{"event_type":"e","conditions":null}', "e", None, False),
        ('{"event_type":"e","conditions":null}', "e", "{}", True),
        ('{"event_type":"e","conditions":{"a":{"b":1}}}', "e", '{"a":{"b":1}}', False),
        ('{"event_type":"e","conditions":{"a":[1]}}', "e", '{"a":[1]}', False),
        ('{"event_type":"e","conditions":{"a":[1]}}', "e", '{"a":""}', True),
        ('{"event_type":"e","conditions":{"a":"1","b":"true"}}', "e", '{"a":1,"b":true,"c":0}', True),
        ('{"event_type":"e","conditions":{"a":"1","b":"true"}}', "e", '{"a":1,"b":false}', False),
        ('{"event_type":"e","conditions":{"a":null}}', "e", '{"a":null}', False),
        ('{"conditions":{"a":"1"}}', "e", '{"a":1}', False),
        ("not json", "e", None, False),
    ],
)
def test_rules(spark, trigger, event_type, properties, want):
    assert match(spark, trigger, event_type, properties) is want


CHANGES = [
    ("demo", "orders_paid", 1, "set", 100, '{"zh":"a","en":"b"}', True),
    ("demo", "orders_paid", 2, "inc", 5, None, None),
    ("demo", "orders_paid", 3, "set", None, '{"zh":"c"}', None),
    ("demo", "gone", 1, "set", 7, None, False),
    ("demo", "gone", 2, "delete", None, None, None),
    ("beta", "visits", 1, "inc", 1, None, None),
    ("beta", "again", 1, "set", 9, '{"zh":"old"}', True),
    ("beta", "again", 2, "delete", None, None, None),
    ("beta", "again", 3, "inc", None, None, None),
]


def counter_log(spark):
    return spark.createDataFrame(CHANGES, "project_id string, counter_key string, seq long, op string, amount long, display_name string, is_public boolean")


def test_many_rules_of_one_type(spark):
    rules = spark.createDataFrame(
        [("demo", f"c{i}", f'{{"event_type":"buy","conditions":{{"k":"{i}"}}}}') for i in range(300)] + [("demo", "all", '{"event_type":"buy"}')],
        "project_id string, counter_key string, event_trigger string",
    )
    events = spark.createDataFrame([("demo", "buy", f'{{"k":{i % 7},"x":1}}') for i in range(70)], "project_id string, event_type string, properties string")
    hits = {r.counter_key: r.hits for r in counters.increments(events, rules).collect()}
    assert hits == {"all": 70} | {f"c{i}": 10 for i in range(7)}


def test_counter_log(spark):
    got = {r.counter_key: (r.counter_value, r.display_name, r.is_public) for r in counters.counter_state(counter_log(spark)).collect()}
    assert got == {"orders_paid": (105, '{"zh":"c"}', True), "visits": (1, None, False), "again": (1, None, False)}


def test_ledger_changes_fold_into_the_log(spark):
    hits = spark.createDataFrame([("demo", "orders_paid", 3)], "project_id string, counter_key string, hits long")
    more = counters.as_changes(hits, F.lit(10), F.lit(T0))
    log = counter_log(spark).unionByName(more, allowMissingColumns=True)
    got = {r.counter_key: r.counter_value for r in counters.counter_state(log).collect()}
    assert got["orders_paid"] == 108


def test_single_counter(spark):
    table = counters.counter_state(counter_log(spark))
    assert [r.counter_value for r in counters.list_counters(table, " demo ", key="orders_paid").collect()] == [105]
    assert counters.list_counters(table, "beta", only_public=True).count() == 0


@pytest.mark.parametrize(
    "header,document,want",
    [
        ("zh-CN,zh;q=0.9", '{"zh":"访问次数","en":"Visits so far"}', "访问次数"),
        ("en-US,en;q=0.8", '{"zh":"访问次数","en":"Visits so far"}', "Visits so far"),
        ("ja-JP", '{"zh":"访问次数"}', "访问次数"),
        ("ja-JP", '{"fr":"seul","de":"x"}', "seul"),
        (None, '"plain"', "plain"),
        (" ", None, ""),
        ("en", "{}", ""),
        ("EN-gb", '{"en":null,"zh":"z"}', "null"),
    ],
)
def test_language(spark, header, document, want):
    df = spark.createDataFrame([(document,)], "d string")
    assert df.select(counters.localized(F.col("d"), counters.language(header))).head()[0] == want


def session(seq, **changed):
    base = dict(
        session_id="00000000-0000-4000-8000-0000000000AA", seq=seq, device_id=DEV, user_id=f"u{seq}", session_start_time=T0 + timedelta(seconds=seq),
        session_duration_ms=seq * 10, screen_count=seq, event_count=None, device_model=f"m{seq}", os_version=None, app_version="1",
        build_number=str(seq), project_id="demo", created_at=T0 + timedelta(minutes=seq),
    )
    return {**base, **changed}


SESSION = (
    "session_id string, seq long, device_id string, user_id string, session_start_time timestamp, session_duration_ms long, screen_count int,"
    "event_count int, device_model string, os_version string, app_version string, build_number string, project_id string, created_at timestamp"
)


def rows_as(spark, rows, schema):
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_sessions_keep_identity_and_replace_the_rest(spark):
    uploads = [session(3), session(1), session(2), session(9, session_id="bad"), session(9, session_start_time=None)]
    got = state.fold_sessions(rows_as(spark, uploads, SESSION)).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.user_id, row.created_at, row.session_duration_ms, row.event_count, row.device_model) == ("u1", T0 + timedelta(minutes=1), 30, 0, "m3")
    assert row.session_id == "00000000-0000-4000-8000-0000000000aa"


def test_sessions_fold_in_two_goes(spark):
    first = state.fold_sessions(rows_as(spark, [session(1), session(2)], SESSION))
    both = state.fold_sessions(rows_as(spark, [session(4, device_model="late")], SESSION), first)
    whole = state.fold_sessions(rows_as(spark, [session(1), session(2), session(4, device_model="late")], SESSION))
    assert sorted(map(str, both.collect())) == sorted(map(str, whole.select(*both.columns).collect()))


REGISTRATION = (
    "project_id string, device_id string, seq long, received_at timestamp, api_key string, secret_key string, device_model string, os_version string, app_version string"
)


def registration(seq, project="demo"):
    return dict(project_id=project, device_id=DEV, seq=seq, received_at=T0 + timedelta(days=seq), api_key=f"ak{seq}", secret_key=f"sk{seq}", device_model="m", os_version=str(seq), app_version="1")


def test_devices(spark):
    first = state.fold_devices(rows_as(spark, [registration(1)], REGISTRATION)).withColumn("is_banned", F.lit(True)).withColumn("ban_reason", F.lit("abuse"))
    later = rows_as(spark, [registration(2), registration(3), registration(1, "beta")], REGISTRATION)
    got = {r.project_id: r for r in state.fold_devices(later, first).collect()}
    demo = got["demo"]
    assert (demo.created_at, demo.last_active_at, demo.api_key, demo.is_banned, demo.ban_reason) == (T0 + timedelta(1), T0 + timedelta(3), "ak3", True, "abuse")
    assert got["beta"].is_banned is False
    answers = {(r.project_id, r.seq): r.is_new for r in state.registration_answers(later, first).collect()}
    assert answers == {("demo", 2): False, ("demo", 3): False, ("beta", 1): True}


def test_status_log(spark):
    base = spark.createDataFrame([(f"r{i}", T0) for i in range(4)], "request_id string, requested_at timestamp")
    log = spark.createDataFrame(
        [
            ("r0", "SUBMITTED", T0, 0, None, None),
            ("r1", "IN_PROGRESS", T0 + timedelta(1), 1, " ann ", "first"),
            ("r1", "COMPLETED", T0 + timedelta(2), 2, " ", "second"),
            ("r2", "REJECTED", T0 + timedelta(1), 1, "bob", None),
            ("r2", "SUBMITTED", T0 + timedelta(3), 2, None, None),
        ],
        "request_id string, status string, changed_at timestamp, seq int, operator string, operator_note string",
    )
    got = {r.request_id: (r.status, r.processed_at, r.closed_at, r.operator, r.operator_note) for r in privacy.request_state(base, log).collect()}
    assert got == {
        "r0": ("SUBMITTED", None, None, None, None),
        "r1": ("COMPLETED", T0 + timedelta(1), T0 + timedelta(2), "ann", "second"),
        "r2": ("SUBMITTED", T0 + timedelta(1), None, "bob", None),
        "r3": ("SUBMITTED", None, None, None, None),
    }


def test_privacy_codes():
    assert privacy.code(" completed ", privacy.STATUSES) == "COMPLETED"
    for bad in ("", "done", None):
        with pytest.raises(ValueError):
            privacy.code(bad, privacy.STATUSES)


def test_status_changes_are_checked(spark):
    rows = [("r", "COMPLETED", "ann", "ok"), ("r", "DONE", "ann", None), ("r", None, "a" * 65, None), ("r", "REJECTED", " " + "a" * 64, "n" * 4001), ("r", "REJECTED", "a" * 64, "n" * 4000)]
    log = spark.createDataFrame(rows, "request_id string, status string, operator string, operator_note string")
    got = [r.reason for r in privacy.checked_status_log(log).collect()]
    assert got == [None, "invalid_status", "operator_too_long", "operator_note_too_long", None]
