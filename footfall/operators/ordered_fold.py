"""Order-dependent folds over keys of any size.

Some rules look back at the last row they kept, so a key has to be read in
order.  Grouping by key would hand a hot key to one task.  Here the rows are
range partitioned by key *and* time instead: Spark cuts a hot key into many
sorted runs, and every run is folded by its own task.

What a run does to the state it starts with is a function, and functions
compose.  A first pass over the rows leaves one short row per run: the function
of its first key, as a table, and the state its last key ends with.  These rows,
one for some millions of input rows, are read in order once and give
the state that each run starts with.  A second pass over the rows makes the outputs.
The number of jobs is the same for any number of runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.session import ensure_checkpoint_dir, scratch_path

#: A run is one task's work: the number of runs grows with the input, and a
#: small input is not cut into more tasks than are worth starting.
ROWS_PER_RUN = 2_000_000
SMALL_RUN = 20_000


@dataclass(frozen=True)
class Fold:
    """A fold by row and by run; states and tables survive JSON, a fresh key starts with None.

    ``step(state, *inputs) -> (state, output)`` takes a row.
    ``table(*columns)`` is what consecutive rows of a key do to a state.
    ``through(table, state)`` is the state they leave.
    """

    step: Callable[..., tuple[object, object]]
    table: Callable[..., object]
    through: Callable[[object, object], object]


_SUMMARY = "run int, first_key string, last_key string, one_key boolean, head string, last_state string"
_ENTRY = "run int, entry string"
_KEY, _RUN, _ENTERED = "__key", "__run", "__entry"


def _summaries(inputs: list[str], fold: Fold):
    """Task that leaves the row of its run; only its first and last key are folded."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        head: list[pd.DataFrame] = []
        tail: list[pd.DataFrame] = []
        for frame in batches:
            if not len(frame):
                continue
            key = frame[_KEY]
            if first is None:
                first = last = key.iloc[0]
            if last == first:
                here = frame[key == first]
                head.append(here[inputs])
            if key.iloc[-1] != last:
                last, tail = key.iloc[-1], []
            if last != first:
                tail.append(frame.loc[key == last, inputs])
        if first is None:
            return
        columns = lambda frames: [pd.concat(frames, ignore_index=True)[c].tolist() for c in inputs]
        ended = fold.through(fold.table(*columns(tail)), None) if tail else None
        row = (TaskContext.get().partitionId(), first, last, first == last, json.dumps(fold.table(*columns(head))), json.dumps(ended))
        yield pd.DataFrame([row], columns=[c.split()[0] for c in _SUMMARY.split(", ")])

    return task


def _entries(fold: Fold):
    """Task that reads the rows of all runs in order and leaves the state each run starts with."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in batches:
            found = []
            for row in frame.itertuples(index=False):
                entry = state if row.first_key == key else None
                if entry is not None:
                    found.append((row.run, json.dumps(entry)))
                state = fold.through(json.loads(row.head), entry) if row.one_key else json.loads(row.last_state)
                key = row.last_key
            yield pd.DataFrame(found, columns=[c.split()[0] for c in _ENTRY.split(", ")])

    return task


def _outputs(inputs: list[str], step, columns: list[str], output: str):
    """Task that folds its runs row by row from the states they start with."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, before = None, None
        for frame in batches:
            made = []
            for key, run, entry, *values in zip(*[frame[c].tolist() for c in [_KEY, _RUN, _ENTERED, *inputs]]):
                if (key, run) != before:
                    # The entry belongs to the key that the run begins with.
                    state = json.loads(entry) if isinstance(entry, str) and (before is None or before[1] != run) else None
                    before = (key, run)
                state, out = step(state, *values)
                made.append(out)
            yield frame[columns].assign(**{output: pd.Series(made, index=frame.index, dtype="object")})

    return task


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold: Fold,
    output: str, output_type: T.DataType, runs: int | None = None,
) -> DataFrame:
    """Fold the rows of every key in order and add the output as a column.

    ``fold`` gets the state and the ``inputs`` of a row.  ``order`` has to be
    total inside a key for repeatable results.  The rows stay pinned in the
    checkpoint folder; ``spark.cleaner.referenceTracking.cleanCheckpoints``
    removes them when the result is no longer used.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if runs is None:
        rows = df.count()
        spread = min(-(-rows // SMALL_RUN), int(spark.conf.get("spark.sql.shuffle.partitions")))
        runs = max(-(-rows // ROWS_PER_RUN), spread, 1)
    # The checkpoint pins rows to runs: a run that is read again, also after
    # an executor is lost, is the same run.
    pinned = (
        df.withColumn(_KEY, F.sha2(F.to_json(F.struct(*keys)), 256))
        .repartitionByRange(runs, *[F.col(c) for c in keys + order])
        .sortWithinPartitions(*keys, *order)
        .checkpoint()
    )
    path = scratch_path(spark, "fold-entries")
    summaries = pinned.select(*dict.fromkeys([_KEY, *inputs])).mapInPandas(_summaries(inputs, fold), _SUMMARY)
    in_order = summaries.repartition(1).sortWithinPartitions("run")
    in_order.mapInPandas(_entries(fold), _ENTRY).write.parquet(path)
    entries = spark.read.schema(_ENTRY).parquet(path).select(F.col("run").alias(_RUN), F.col("entry").alias(_ENTERED))
    # A small table of entries is broadcast and the rows stay in order, so the
    # sort finds them sorted; a large one is joined by shuffle.
    entered = pinned.withColumn(_RUN, F.spark_partition_id()).join(entries, _RUN, "left").sortWithinPartitions(_RUN, *keys, *order)
    schema = T.StructType(df.schema.fields + [T.StructField(output, output_type)])
    return entered.mapInPandas(_outputs(inputs, fold.step, df.columns, output), schema)
