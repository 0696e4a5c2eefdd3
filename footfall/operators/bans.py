"""Ban windows after repeated failed sign-ins."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F, types as T

from footfall.operators.ordered_fold import Fold, ordered_fold

MAX_FAILURES = 5
BAN_MICROS = 15 * 60 * 1_000_000


def count_failures(state, at: int, success: bool) -> tuple[list | None, int | None]:
    """Fold of one address: state is [failures, time of the first one].

    The output is the time of the first failure on the attempt that starts a
    ban, null elsewhere.
    """
    if state is not None and at - state[1] >= BAN_MICROS:
        state = None
    if state is not None and state[0] >= MAX_FAILURES:
        return state, None  # banned: the attempt does not count
    if success:
        return None, None
    state = [state[0] + 1, state[1]] if state is not None else [1, at]
    return state, state[1] if state[0] == MAX_FAILURES else None


def attempts_table(times: list[int], successes: list[bool]) -> dict:
    """What consecutive attempts of an address do to the state before them.

    A state ends in one of three ways: by a success, if fewer than the missing
    failures come before it; by its time, at the first attempt from then on;
    or not at all.  From there on the count begins anew, so the attempts are
    followed backwards once, from each to where its own count ends.
    """
    n = len(times)
    fails = [i for i, ok in enumerate(successes) if not ok]
    fresh: list = [None] * (n + 1)  # state left by a count that begins at a row
    success, later = n, len(fails)  # first success and number of the first failure from a row on
    for i in range(n - 1, -1, -1):
        if successes[i]:
            success, fresh[i] = i, fresh[i + 1]
            continue
        later -= 1
        over = bisect_left(times, times[i] + BAN_MICROS, i + 1)
        last = later + MAX_FAILURES - 1
        banned = fails[last] if last < len(fails) else n
        if banned < min(over, success):
            fresh[i] = fresh[over] if over < n else [MAX_FAILURES, times[i]]
        elif success < over:
            fresh[i] = fresh[success + 1]
        else:
            fresh[i] = fresh[over] if over < n else [len(fails) - later, times[i]]
    # A state from before is over BAN_MICROS after the first row at the latest.
    reach = min(n, bisect_left(times, times[0] + BAN_MICROS) + 1)
    steps: list = []
    for i in range(reach):
        if steps and steps[-1][1] == fresh[i]:
            steps[-1][0] = times[i]
        else:
            steps.append([times[i], fresh[i]])
    first_success = successes.index(True) if True in successes else n
    cleared = [times[first_success], fresh[first_success + 1]] if first_success < n else None
    return {"fresh": fresh[0], "steps": steps, "fails": len(fails), "before_success": min(first_success, len(fails)), "cleared": cleared}


def through_attempts(table: dict, state: list | None) -> list | None:
    """The state that the attempts leave behind another one."""
    if state is None:
        return table["fresh"]
    failures, first = state
    over = first + BAN_MICROS
    # Before the first success all attempts are failures.
    if table["cleared"] and failures + table["before_success"] < MAX_FAILURES and table["cleared"][0] < over:
        return table["cleared"][1]
    for at, left in table["steps"]:
        if at >= over:
            return left
    return [min(MAX_FAILURES, failures + table["fails"]), first]


FAILURES = Fold(count_failures, attempts_table, through_attempts)


def ban_windows(attempts: DataFrame, runs: int | None = None) -> DataFrame:
    """Bans per address: five failures within 15 minutes of the first one.

    The ban lasts until 15 minutes after the first failure; a success before
    the fifth failure clears the count.
    """
    timed = attempts.select("ip", "seq", "success", F.unix_micros(F.col("attempted_at").cast("timestamp")).alias("at_us"))
    folded = ordered_fold(
        timed, ["ip"], ["at_us", "seq"], ["at_us", "success"], FAILURES, "first_us", T.LongType(), runs
    )
    return folded.where(F.col("first_us").isNotNull()).select(
        "ip",
        F.timestamp_micros("first_us").alias("first_failure_at"),
        F.timestamp_micros("at_us").alias("banned_from"),
        F.timestamp_micros(F.col("first_us") + BAN_MICROS).alias("banned_until"),
    )
