"""Order-dependent folds over streams whose rows arrive out of order.

Rows wait in the state of their key until the watermark has passed them, so all
earlier rows are there; then they go through the fold in time order.  Event-time timers wake
a key for its next waiting row and for the moment its state means nothing any more;
after that nothing of the key is left.

A row behind the watermark is no guess: it leaves marked ``late`` and does not
touch the fold.  Spark drops late rows unseen, so its own watermark is kept ``grace`` behind
the one used here; rows later than that are in its ``numRowsDroppedByWatermark``.

What waits is what one key brings within the delay.  Its rows lie in slices of many rows each, sorted by time and told
apart by an index: a wake-up opens the slices that are due and no others.  What is left of these is cut anew, so
that a row is rewritten about once, however often the key is woken.  The state lives in RocksDB on executor disks
and in the checkpoint.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from footfall.schemas import struct
from footfall.streaming.ledger import open_ledger, write_batch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"
_TEXT = T.StructType([T.StructField("json", T.StringType())])
#: Rows of a slice, and of a frame that leaves a key.
SLICE_ROWS = 10_000


class InOrder(StatefulProcessor):
    """``step(state, *row) -> (state, output)``; ``ends(state)`` is the last moment at which it matters, in microseconds."""

    def __init__(self, step: Callable, ends: Callable, keys: list[str], waiting: T.StructType, output: T.DataType, grace_ms: int):
        self.step, self.ends, self.keys, self.waiting_schema, self.output, self.grace = step, ends, keys, waiting, output, grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", T.StructType([T.StructField("id", T.LongType())]), _TEXT)
        self.index = handle.getValueState("index", _TEXT)
        self.state = handle.getValueState("state", _TEXT)

    @staticmethod
    def _read(value) -> object:
        found = value.get()
        return None if found is None else json.loads(found[0])

    def _keep(self, index: dict, rows: list[tuple]) -> None:
        """Store sorted rows as slices; the index has [id, first time, last time] of each."""
        for start in range(0, len(rows), SLICE_ROWS):
            some = rows[start : start + SLICE_ROWS]
            self.slices.updateValue((index["next"],), (json.dumps(list(zip(*some))),))
            index["slices"].append([index["next"], some[0][0], some[-1][0]])
            index["next"] += 1

    def _now(self, timers) -> int:
        """Microseconds up to which all rows are there."""
        return (timers.getCurrentWatermarkInMs() + self.grace) * 1000

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000) - self.grace)

    def _frame(self, key: tuple, rows: list[tuple], outputs: list, late: bool) -> pd.DataFrame:
        names = self.waiting_schema.fieldNames()
        frame = pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="object") for i, n in enumerate(names)})
        made = {k: pd.Series([v] * len(rows), dtype="object") for k, v in zip(self.keys, key)}
        return frame.assign(**made, output=pd.Series(outputs, dtype="object"), late=late)[[*self.keys, *names, "output", "late"]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, names = self._now(timerValues), self.waiting_schema.fieldNames()
        index = self._read(self.index) or {"next": 0, "slices": []}
        stored = index["next"]
        woken = min((low for _, low, _ in index["slices"]), default=None)
        for frame in rows:
            frame = frame[~frame["clock"]]
            found = sorted(zip(*[frame[n].tolist() for n in names]))
            cut = bisect_right(found, now, key=itemgetter(0))
            if cut < len(found):
                self._keep(index, found[cut:])
            if cut:
                yield self._frame(key, found[:cut], [None] * cut, True)
        if index["next"] > stored:
            self.index.update((json.dumps(index),))
            first = min(low for _, low, _ in index["slices"])
            if woken is None or first < woken:
                self._wake(first)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        index = self._read(self.index) or {"next": 0, "slices": []}
        due = [i for i, low, _ in index["slices"] if low <= now]
        state = self._read(self.state)
        if not due and (state is None or self.ends(state) > now):
            return  # an earlier timer of this key has done it all
        held = []
        for i in due:
            held += zip(*json.loads(self.slices.getValue((i,))[0]))
            self.slices.removeKey((i,))
        held.sort()
        cut = bisect_right(held, now, key=itemgetter(0))
        ready, rest = held[:cut], held[cut:]
        made = []
        for row in ready:
            state, out = self.step(state, *row)
            made.append(out)
        index["slices"] = [part for part in index["slices"] if part[1] > now]
        self._keep(index, rest)
        if index["slices"]:
            self.index.update((json.dumps(index),))
            self._wake(min(low for _, low, _ in index["slices"]))
        else:
            self.index.clear()
        if state is not None and self.ends(state) > now:
            self.state.update((json.dumps(state),))
            self._wake(self.ends(state))
        else:
            self.state.clear()
        for start in range(0, len(ready), SLICE_ROWS):
            yield self._frame(key, ready[start : start + SLICE_ROWS], made[start : start + SLICE_ROWS], False)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame, keys: list[str], waiting: str, step: Callable, ends: Callable, output: T.DataType, grace_s: int
) -> DataFrame:
    """Fold a stream: the keys, the ``waiting`` columns, ``output`` and ``late`` of every row.

    ``waiting`` names columns, as in ``schemas.struct``, that carry a row through the state; the first is its time
    in microseconds and together they put rows of a key in order, so none may be null.  ``rows`` has a watermark, and a
    boolean ``clock`` that is true for rows that only move the time on.
    """
    schema = struct(waiting)
    found = T.StructType(
        [rows.schema[k] for k in keys] + list(schema.fields) + [T.StructField("output", output), T.StructField("late", T.BooleanType())]
    )
    processor = InOrder(step, ends, keys, schema, output, grace_s * 1000)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, found, "Append", "EventTime")


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None):
    """RocksDB, and the number of state partitions, for the queries started inside.

    The number stays with a checkpoint for good, so a stream that is to grow needs as many as
    it may have executors later; None takes the session's shuffle partitions.
    """
    before = {k: spark.conf.get(k, None) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, _ROCKSDB)
    if partitions:
        spark.conf.set(_PARTITIONS, str(partitions))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def store_stream(results: DataFrame, path: str, checkpoint: str, once: bool = False, partitions: int | None = None) -> StreamingQuery:
    """Write the results of a fold batch by batch to a ledger."""
    spark = results.sparkSession
    open_ledger(spark, path, results.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    writer = results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_settings(spark, partitions):
        return (writer.trigger(availableNow=True) if once else writer).start()


def at_micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))
