"""Streaming forms of the order-dependent folds.

Both wait for ``delay_s`` seconds of event time before they answer, so files may
arrive in any order within it, and give the answers of the batch forms.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, functions as F, types as T

from footfall.operators.bans import BAN_MICROS, count_failures
from footfall.operators.privacy import OPEN, REUSE_SECONDS, SAME_REQUEST, reuse_open
from footfall.streaming.in_order import at_micros, in_order

REUSE_MICROS = REUSE_SECONDS * 1_000_000
CHANGE, SUBMISSION = 0, 1


def reuse_or_leave(state: dict | None, at: int, kind: int, row_id: str) -> tuple[dict, str | None]:
    """Fold of one key over submissions and status changes, changes of a moment first.

    The state has the open request with the last moment it can be reused, and
    the moments of changes whose request has not been seen, in order of time: the oldest are dropped from the front.
    """
    opened, early = (state["open"], state["early"]) if state else (None, {})
    early = early if isinstance(early, OrderedDict) else OrderedDict(early)
    while early and next(iter(early.values())) < at - REUSE_MICROS:
        early.popitem(last=False)
    answer = None
    if kind == SUBMISSION:
        opened, answer = reuse_open(opened, row_id, at, early.pop(row_id, None))
    elif opened is not None and opened[0] == row_id:
        opened = [row_id, min(opened[1], at - 1)]
    else:
        early[row_id] = min(at, early.get(row_id, at))
    return {"open": opened, "early": early}, answer


def _reuse_ends(state: dict) -> int:
    last = [v + REUSE_MICROS for v in state["early"].values()]
    return max([*last, *([state["open"][1]] if state["open"] else [])], default=0)


def dedup_request_stream(submissions: DataFrame, changes: DataFrame | None = None, delay_s: int = 600, grace_s: int = 3600) -> DataFrame:
    """``request_id``, ``answered_by`` and ``late`` for every submission of the stream.

    ``changes`` has the columns of SAME_REQUEST, request_id, status and changed_at: a request that
    has left SUBMITTED is not reused from then on.  A null request_id marks a row that only moves the time on.  A
    late submission has no answer; a late change is reported with a null answer as well, and
    ``kind`` tells them apart.  The state of a key ends REUSE_SECONDS after its last row.
    """
    def timed(rows: DataFrame, time: str, kind: int, clock: Column) -> DataFrame:
        marked = rows.withColumn("time", F.col(time).cast("timestamp")).withWatermark("time", f"{delay_s + grace_s} seconds")
        return marked.select(
            *SAME_REQUEST, "time", at_micros("time").alias("at_us"), F.lit(kind).alias("kind"),
            F.coalesce("request_id", F.lit("")).alias("request_id"), clock.alias("clock"),
        )

    rows = timed(submissions, "requested_at", SUBMISSION, F.col("request_id").isNull())
    if changes is not None:
        left = F.col("request_id").isNull() | F.col("status").isNull() | (F.col("status") == OPEN)
        rows = rows.unionByName(timed(changes, "changed_at", CHANGE, left))
    found = in_order(rows, SAME_REQUEST, "at_us bigint, kind int, request_id string", reuse_or_leave, _reuse_ends, T.StringType(), grace_s)
    answers = found.where((F.col("kind") == SUBMISSION) | F.col("late"))
    return answers.select("request_id", F.col("output").alias("answered_by"), "kind", "late")


def _count(state: list | None, at: int, seq: int, success: bool) -> tuple[list | None, int | None]:
    return count_failures(state, at, success)


def _count_ends(state: list) -> int:
    return state[1] + BAN_MICROS


def ban_window_stream(attempts: DataFrame, delay_s: int = 60, grace_s: int = 900) -> DataFrame:
    """Bans as they begin, and late attempts with ``late`` true and null bounds.

    A null ``success`` marks a row that only moves the time on.  The state of an address ends with its
    15 minutes.
    """
    rows = attempts.withColumn("time", F.col("attempted_at").cast("timestamp")).withWatermark("time", f"{delay_s + grace_s} seconds")
    rows = rows.select("ip", "time", at_micros("time").alias("at_us"), F.col("seq").cast("long").alias("seq"), F.coalesce("success", F.lit(False)).alias("success"), F.col("success").isNull().alias("clock"))
    found = in_order(rows, ["ip"], "at_us bigint, seq bigint, success boolean", _count, _count_ends, T.LongType(), grace_s)
    return found.where(F.col("late") | F.col("output").isNotNull()).select(
        "ip", "seq",
        F.timestamp_micros("output").alias("first_failure_at"),
        F.when(~F.col("late"), F.timestamp_micros("at_us")).alias("banned_from"),
        F.timestamp_micros(F.col("output") + BAN_MICROS).alias("banned_until"),
        "late",
    )
