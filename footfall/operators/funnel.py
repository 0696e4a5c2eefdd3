"""Ordered funnels with first-touch grouping.

An actor enters with its first step-1 event and reaches step ``i`` with the
first event of that type at or after the time of step ``i - 1``.  The chain is
order dependent, so a plain aggregate cannot follow it, while one window over
an actor would put all events of a busy actor into one task.  The range is
therefore cut into time slots: each (actor, slot) is resolved on its own into
"from step j the actor leaves this slot at step n", and one small array per
actor chains the slots.  A busy actor is spread over up to ``MAX_SLOTS`` groups
and its second stage holds at most that many short rows.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.functions.actors import actor
from footfall.functions.json import json_text
from footfall.functions.text import is_blank
from footfall.ranges import EPOCH, TimeRange, comma_list, in_project

MAX_STEPS = 12
MAX_SLOTS = 10_000
MIN_SLOT = timedelta(minutes=10)
ALL_GROUP, NO_VALUE, EMPTY_VALUE = "all", "(none)", "(empty)"

_EVENT_NAME = re.compile(r"[A-Za-z0-9_.:-]{1,100}")
_PROPERTY_KEY = re.compile(r"[A-Za-z0-9_.:-]{1,80}")


def event_name(value: str | None) -> str:
    name = (value or "").strip()
    if not _EVENT_NAME.fullmatch(name):
        raise ValueError(f"malformed event name: {value!r}")
    return name


def event_names(value: str | list[str]) -> list[str]:
    """Distinct step names in the given order."""
    names = [event_name(raw) for raw in comma_list(value)]
    names = list(dict.fromkeys(names))
    if not names:
        raise ValueError("at least one step is required")
    if len(names) > MAX_STEPS:
        raise ValueError(f"at most {MAX_STEPS} steps")
    return names


def property_key(value: str | None) -> str | None:
    key = (value or "").strip()
    if not key:
        return None
    if not _PROPERTY_KEY.fullmatch(key):
        raise ValueError(f"malformed property key: {value!r}")
    return key


def rate(value: Column) -> Column:
    """Four decimals, halves up."""
    return F.floor(value * 10000 + F.lit(0.5)) / F.lit(10000.0)


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _group_value(key: str | None) -> Column:
    if key is None:
        return F.lit(ALL_GROUP)
    text = json_text(F.col("properties"), key)
    return (
        F.when(is_blank(F.col("properties")), F.lit(ALL_GROUP))
        .when(text.isNull(), F.lit(NO_VALUE))
        .when(is_blank(text), F.lit(EMPTY_VALUE))
        .otherwise(text)
    )


def _slot_micros(rng: TimeRange) -> int:
    micros = rng.span // timedelta(microseconds=1)
    return max(MIN_SLOT // timedelta(microseconds=1), -(-micros // MAX_SLOTS))


def funnel(
    events: DataFrame,
    project_id: str,
    rng: TimeRange,
    steps: str | list[str],
    group_by: str | None = None,
) -> DataFrame:
    """Users, conversion and drop-off of every step, per group."""
    names = event_names(steps)
    count = len(names)
    key = property_key(group_by)
    origin = _micros_of(rng)

    step = F.coalesce(*[F.when(F.col("event_type") == n, F.lit(i)) for i, n in enumerate(names)])
    hits = (
        in_project(events, project_id, "created_at", rng)
        .where(F.col("event_type").isin(names))
        .select(
            actor().alias("actor"),
            _micros("created_at").alias("at"),
            step.alias("step"),
            # Only the entry decides the group, later steps carry no text.
            F.when(F.col("event_type") == names[0], F.struct(F.col("event_id"), _group_value(key).alias("grp"))).alias("entry"),
        )
        .where(~is_blank(F.col("actor")))
        .withColumn("slot", F.floor((F.col("at") - F.lit(origin)) / F.lit(_slot_micros(rng))).cast("int"))
    )

    # at_j_i: time of step i inside the slot if the actor enters it waiting
    # for step j.  All windows share one exchange and one sort.
    slot = Window.partitionBy("actor", "slot")
    for length in range(count):
        found = []
        for j in range(count - length):
            i = j + length
            match = F.col("step") == i
            if length:
                match = match & (F.col("at") >= F.col(f"at_{j}_{i - 1}"))
            found.append(F.min(F.when(match, F.col("at"))).over(slot).alias(f"at_{j}_{i}"))
        hits = hits.select("*", *found)

    def leaves_at(j: int) -> Column:
        done = [F.col(f"at_{j}_{i}").isNotNull().cast("int") for i in range(j, count)]
        return (F.lit(j) + sum(done[1:], done[0])).cast("tinyint")

    per_slot = hits.groupBy("actor", "slot").agg(
        F.min(F.when(F.col("entry").isNotNull(), F.struct("at", "entry"))).alias("entry"),
        F.max(F.array(*[leaves_at(j) for j in range(count)])).alias("leaves"),
    )
    per_actor = (
        per_slot.groupBy("actor")
        .agg(
            F.min("entry").alias("entry"),
            F.sort_array(F.collect_list(F.struct("slot", "leaves"))).alias("path"),
        )
        .where(F.col("entry").isNotNull())
        .select(
            F.col("entry.entry.grp").alias("group_value"),
            F.aggregate(
                "path",
                F.lit(0),
                lambda reached, s: F.when(reached < count, F.element_at(s["leaves"], reached + 1).cast("int")).otherwise(
                    reached
                ),
            ).alias("reached"),
        )
    )
    reached = per_actor.groupBy("group_value").agg(
        F.array(*[F.sum((F.col("reached") > i).cast("bigint")) for i in range(count)]).alias("users")
    )
    users = F.get(F.col("users"), F.col("i"))
    first = F.get(F.col("users"), F.lit(0))
    before = F.get(F.col("users"), F.col("i") - 1)
    table = reached.select("group_value", "users", F.explode(F.array(*[F.lit(i) for i in range(count)])).alias("i")).select(
        "group_value",
        (F.col("i") + 1).alias("step"),
        F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("event_type"),
        users.alias("users"),
        rate(F.when(first == 0, F.lit(0.0)).otherwise(users / first)).alias("conversion_rate"),
        rate(F.when((F.col("i") == 0) | (before == 0), F.lit(0.0)).otherwise(1 - users / before)).alias("drop_off_rate"),
    )
    # A single group is one exploded row and comes out in step order.
    return table if key is None else table.orderBy("group_value", "step")


def _micros_of(rng: TimeRange) -> int:
    return (rng.start - EPOCH) // timedelta(microseconds=1)
