"""Rollups equal the overview and read only the days whose files changed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import metrics
from footfall.operators.rollups import Rollups
from footfall.plans.fixtures import view
from footfall.ranges import resolve_range
from footfall.sources.files import remove
from footfall.sources.tables import TableStore


def test_rollups_follow_the_tables(spark, small, tmp_path):
    store = TableStore(str(tmp_path / "tables"))
    store.create(spark)
    rollups = Rollups(store, str(tmp_path / "rollups"))
    rollups.create(spark)
    rng = resolve_range("2024-01-03", "2024-01-20")

    def check():
        tables = [store.read(spark, t) for t in ("devices", "sessions", "events")]
        want = metrics.overview(*tables, "demo", rng).collect()
        assert rollups.overview(spark, "demo", rng).collect() == want
        return want[0]

    check()
    for table, name in (("devices", "v_devices"), ("sessions", "v_sessions"), ("events", "v_events")):
        rows = view(spark, small, name)
        store.append(rows.withColumn("secret_key", F.lit(None).cast("string")), table)
    first = rollups.refresh(spark)
    assert first["events"] > 20 and first["devices"] > 1
    before = check()
    assert rollups.refresh(spark) == {"devices": 0, "events": 0, "sessions": 0}

    # One more event of a new user on one day: that day alone is read again.
    row = view(spark, small, "v_events").where("project_id = 'demo'").limit(1)
    moved = row.withColumns({"created_at": F.lit(datetime(2024, 1, 9, 5)).cast("timestamp_ntz"), "user_id": F.lit("somebody new")})
    store.append(moved, "events")
    changed = rollups.changed(spark, "events").collect()
    assert [(r.project_id, r.dt) for r in changed] == [("demo", "2024-01-09")]
    assert rollups.refresh(spark) == {"devices": 0, "events": 1, "sessions": 0}
    after = check()
    assert (after.events_total, after.users_active) == (before.events_total + 1, before.users_active + 1)

    # A day whose files are gone.
    remove(spark, f"{store.path('events')}/project_id=demo/dt=2024-01-09")
    assert rollups.refresh(spark)["events"] == 1
    assert check().events_total < before.events_total
    with pytest.raises(ValueError):
        rollups.overview(spark, "demo", type(rng)(rng.start + timedelta(hours=1), rng.end))


def test_rules_meet_at_their_rarest_condition_and_see_few_properties(spark):
    from footfall.operators import counters
    from footfall.operators.counters import _met_at, increments, rules

    wide = ",".join(f'"x{k}":{k}' for k in range(40))
    rows = [("p", "buy", f'{{"country":"US","plan":"{"gold" if i % 10 == 0 else "free"}",{wide}}}') for i in range(50)] + [("p", "buy", None), ("p", "see", '{"plan":"gold"}')]
    events = spark.createDataFrame(rows, "project_id string, event_type string, properties string")
    made = [("p", "both", '{"event_type":"buy","conditions":{"country":"US","plan":"gold"}}'), ("p", "one", '{"event_type":"buy","conditions":{"country":"US"}}'),
            ("p", "none", '{"event_type":"buy","conditions":{"country":"US","plan":"silver"}}'), ("p", "all", '{"event_type":"buy"}'), ("p", "off", None)]
    rule_rows = spark.createDataFrame(made, "project_id string, counter_key string, event_trigger string")
    assert {r.counter_key: r.hits for r in increments(events, rule_rows).collect()} == {"both": 5, "one": 50, "all": 51}
    members = events.where("properties is not null").select("project_id", "event_type", F.explode(counters.as_text_map(F.col("properties"))).alias("name", "value"))
    met = {r.counter_key: (r["name"], r["value"]) for r in _met_at(rules(rule_rows).where("size(conditions) > 0"), members).collect()}
    assert met == {"both": ("plan", "gold"), "one": ("country", "US"), "none": ("plan", "silver")}
    assert increments(events, rule_rows.where("counter_key = 'all'")).collect()[0].hits == 51
    exploded = increments(events, rule_rows)
    exploded.collect()
    assert "map_filter" in exploded._jdf.queryExecution().optimizedPlan().toString()
