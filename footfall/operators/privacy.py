"""Privacy requests: checks, reuse of open requests, status and latest."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F, types as T

from footfall.functions.actors import request_id
from footfall.functions.text import first_reason, is_blank, longer_than, privacy_source, strip_ends
from footfall.operators.ordered_fold import Fold, ordered_fold

# Fixed values of the request records.
REQUEST_TYPES = ("EXPORT", "DELETE")
STATUSES = ("SUBMITTED", "IN_PROGRESS", "COMPLETED", "REJECTED", "CANCELLED")
FINAL_STATUSES = ("COMPLETED", "REJECTED", "CANCELLED")
OPEN = "SUBMITTED"
REUSE_SECONDS = 600
OPERATOR_LENGTH, NOTE_LENGTH = 64, 4000

SAME_REQUEST = ["project_id", "user_id", "device_id", "request_type", "processor", "contact_email"]

_CODE = re.compile(r"[A-Z0-9_]{1,32}")


def code(value: str, allowed: tuple[str, ...] | None = None) -> str:
    """Upper-case code from a caller; an unknown one is an error."""
    name = (value or "").strip().upper()
    if not _CODE.fullmatch(name) or (allowed is not None and name not in allowed):
        raise ValueError(f"unknown value: {value!r}")
    return name


def checked_requests(requests: DataFrame, processors: tuple[str, ...] | None = None) -> DataFrame:
    """Submissions in stored form with a ``reason`` column.

    ``processors`` names the systems of the deployment that may hold data.
    """
    kind, handler = F.upper(strip_ends(F.col("request_type"))), F.upper(strip_ends(F.col("processor")))
    email, note = strip_ends(F.col("contact_email")), strip_ends(F.col("requester_note"))
    known = handler.isin(*processors) if processors else handler.rlike("^[A-Z0-9_]{1,32}$")
    reason = first_reason(
        (is_blank(F.col("user_id")), "missing_user_id"),
        (F.col("device_id").isNull(), "missing_device_id"),
        (~F.coalesce(kind.isin(*REQUEST_TYPES), F.lit(False)), "invalid_request_type"),
        (~F.coalesce(known, F.lit(False)), "invalid_processor"),
        (is_blank(F.col("contact_email")), "missing_contact_email"),
        (longer_than(email, 255), "contact_email_too_long"),
        (privacy_source(F.col("source")).isNull(), "invalid_source"),
        (longer_than(note, 4000), "requester_note_too_long"),
    )
    return requests.select(
        request_id(
            *[F.col(c) for c in ("project_id", "user_id", "device_id", "request_type", "processor", "contact_email")],
            F.unix_micros(F.col("received_at").cast("timestamp")),
        ).alias("request_id"),
        "project_id", "user_id", "device_id",
        kind.alias("request_type"), handler.alias("processor"), privacy_source(F.col("source")).alias("source"),
        F.lit(OPEN).alias("status"), email.alias("contact_email"),
        F.when(~is_blank(F.col("requester_note")), note).alias("requester_note"),
        "metadata", F.col("received_at").alias("requested_at"), reason.alias("reason"),
    )


def reuse_open(state, row_id: str, at: int, left_at) -> tuple[list, str]:
    """Fold of one key: state is [request id, last moment it can be reused].

    A request that is reused leaves the state alone; a new one replaces it.
    """
    if state is not None and at <= state[1]:
        return state, state[0]
    until = at + REUSE_SECONDS * 1_000_000
    if left_at is not None and left_at == left_at:  # not null, not NaN
        until = min(until, int(left_at) - 1)
    return [row_id, until], row_id


def requests_table(ids: list[str], times: list[int], lefts: list) -> list:
    """What consecutive submissions of a key do to the open request before them.

    Rows [time, request left open]: the first one later than the old request
    can be reused is the first that becomes a request of its own.  Each row is
    followed backwards once, to the row that takes over from it.
    """
    n = len(ids)
    left: list = [None] * n
    for i in range(n - 1, -1, -1):
        (made, until), _ = reuse_open(None, ids[i], times[i], lefts[i])
        after = bisect_right(times, until, i + 1)
        left[i] = left[after] if after < n else [made, until]
    # An old request can be reused REUSE_SECONDS after the first row at the latest.
    reach = min(n, bisect_right(times, times[0] + REUSE_SECONDS * 1_000_000) + 1)
    steps: list = []
    for i in range(reach):
        if steps and steps[-1][1] == left[i]:
            steps[-1][0] = times[i]
        else:
            steps.append([times[i], left[i]])
    return steps


def through_requests(table: list, state: list | None) -> list | None:
    """The open request that the submissions leave."""
    for at, left in table:
        if state is None or at > state[1]:
            return left
    return state


REUSE = Fold(reuse_open, requests_table, through_requests)


def dedup_requests(submissions: DataFrame, runs: int | None = None) -> DataFrame:
    """Every submission with ``answered_by``, the request that stands for it.

    A submission reuses the open request of the same person, device, kind,
    processor and address from the last 600 seconds; the window is counted
    from the request that was stored, not from the last repeat.  An optional
    ``left_submitted_at`` says when a request stopped being open.  Stored
    requests are the rows with ``answered_by = request_id``.
    """
    left = F.col("left_submitted_at") if "left_submitted_at" in submissions.columns else F.lit(None)
    timed = submissions.withColumn("at_us", F.unix_micros(F.col("requested_at").cast("timestamp"))).withColumn(
        "left_us", F.unix_micros(left.cast("timestamp"))
    )
    folded = ordered_fold(
        timed, SAME_REQUEST, ["at_us", "request_id"], ["request_id", "at_us", "left_us"],
        REUSE, "answered_by", T.StringType(), runs,
    )
    return folded.drop("at_us", "left_us")


def stored_requests(submissions: DataFrame, runs: int | None = None) -> DataFrame:
    """Submissions that became requests of their own."""
    return dedup_requests(submissions, runs).where(F.col("answered_by") == F.col("request_id")).drop("answered_by")


def notices(sent: DataFrame) -> DataFrame:
    """Manual notices as rows of the status log: the note says so, the status stays.

    ``sent`` has request_id, seq, sent_at, subject and operator.
    """
    at = F.date_format(F.col("sent_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return sent.select(
        "request_id", F.lit(None).cast("string").alias("status"), F.col("sent_at").alias("changed_at"), "seq", "operator",
        F.concat_ws(" ", F.lit("[manual-notify]"), at, F.trim("subject")).alias("operator_note"),
    )


def checked_status_log(status_log: DataFrame) -> DataFrame:
    """Status changes with a ``reason`` column; only rows without one may reach the state."""
    checks = [(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "invalid_status")]
    for name, size in (("operator", OPERATOR_LENGTH), ("operator_note", NOTE_LENGTH)):
        if name in status_log.columns:
            checks.append((longer_than(F.trim(name), size), f"{name}_too_long"))
    return status_log.withColumn("reason", first_reason(*checks))


def request_state(submissions: DataFrame, status_log: DataFrame) -> DataFrame:
    """Requests with the status, times and notes their log leads to.

    ``processed_at`` is set once, when the request first leaves SUBMITTED;
    ``closed_at`` only while the status is final, so reopening clears it.  A
    log row without status changes the notes only.
    """
    def last_text(name: str):
        value = F.col(name)
        return F.max(F.when(~is_blank(value), F.struct("seq", F.trim(value).alias("v"))))["v"].alias(name)

    extras = [n for n in ("operator", "operator_note", "result_payload") if n in status_log.columns]
    folded = (
        status_log.groupBy("request_id")
        .agg(
            F.max(F.when(F.col("status").isNotNull(), F.struct("seq", "status", "changed_at"))).alias("last"),
            F.min(F.when(F.col("status") != OPEN, F.struct("seq", "changed_at")))["changed_at"].alias("processed_at"),
            F.max("changed_at").alias("updated_at"),
            *[last_text(n) for n in extras],
        )
        .select("request_id", "last.status", F.col("last.changed_at").alias("status_at"), "processed_at", "updated_at", *extras)
    )
    base = submissions.drop("status", "processed_at", "closed_at", "updated_at", *extras)
    return (
        base.join(folded, "request_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(OPEN)))
        .withColumn("closed_at", F.when(F.col("status").isin(*FINAL_STATUSES), F.col("status_at")))
        .withColumn("updated_at", F.coalesce("updated_at", "requested_at"))
        .drop("status_at")
    )


def request_by_id(requests: DataFrame, project_id: str, wanted: str, user_id: str | None = None) -> DataFrame:
    """One request, for its user or for an administrator."""
    rows = requests.where((F.col("project_id") == project_id) & (F.col("request_id") == wanted))
    return rows if user_id is None else rows.where(F.col("user_id") == user_id)


def latest_requests(requests: DataFrame) -> DataFrame:
    """The newest request of every user."""
    newest = Window.partitionBy("project_id", "user_id").orderBy(F.desc("requested_at"), F.desc("request_id"))
    return requests.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")
