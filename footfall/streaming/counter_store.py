"""Counters as a snapshot and the changes after it.

Changes land batch by batch in a ledger.  Compaction folds the snapshot and the batches after it into a
new snapshot, named after its last batch, and then appends that name to a table of versions; the append is
atomic, so a reader sees the old snapshot with all later batches or the new one with fewer, which is the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.operators.counters import TEXT_FIELDS, counter_state
from footfall.schemas import struct
from footfall.sources.files import remove
from footfall.streaming.ledger import open_ledger, read_ledger, write_batch

CHANGES = struct(
    "project_id string, counter_key string, seq bigint, op string, amount bigint, changed_at timestamp,"
    "display_name string, unit string, event_trigger string, is_public boolean, description string"
)
STATE = struct(
    "project_id string, counter_key string, counter_value bigint, display_name string, unit string, event_trigger string,"
    "description string, is_public boolean, created_at timestamp, updated_at timestamp, seq bigint"
)
_VERSIONS = struct("version bigint")


def as_log(state: DataFrame) -> DataFrame:
    """A state as changes that lead to it: a set of all fields, and a bare one at the time the counter was made."""
    key = [F.col(c) for c in ("project_id", "counter_key", "seq")]
    last = state.select(*key, F.lit("set").alias("op"), F.col("counter_value").alias("amount"), F.col("updated_at").alias("changed_at"), *TEXT_FIELDS)
    made = state.select(*key, F.lit("set").alias("op"), F.lit(None).cast("bigint").alias("amount"), F.col("created_at").alias("changed_at"))
    return last.unionByName(made, allowMissingColumns=True)


@dataclass(frozen=True)
class CounterStore:
    """``seq`` grows with the batches: no change comes before one that has been compacted."""

    path: str

    def _ledger(self) -> str:
        return f"{self.path}/changes"

    def _snapshot(self, version: int) -> str:
        return f"{self.path}/state/version={version}"

    def create(self, spark: SparkSession) -> None:
        open_ledger(spark, self._ledger(), CHANGES)
        spark.createDataFrame([], _VERSIONS).write.mode("overwrite").parquet(f"{self.path}/versions")

    def append(self, changes: DataFrame, batch: int) -> None:
        """Land the changes of a batch; a repeat overwrites them."""
        known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in CHANGES]
        write_batch(changes.select(*known), self._ledger(), batch)

    def version(self, spark: SparkSession) -> int:
        """Last batch of the snapshot, -1 without one."""
        found = spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]
        return -1 if found is None else found

    def log(self, spark: SparkSession, through: int | None = None) -> DataFrame:
        """The snapshot as changes, and the batches after it up to one; older folders are not opened."""
        version = self.version(spark)
        batches = read_ledger(spark, self._ledger(), CHANGES).where(F.col("batch") > version)
        if through is not None:
            batches = batches.where(F.col("batch") <= through)
        later = batches.drop("batch")
        return later if version < 0 else later.unionByName(as_log(spark.read.schema(STATE).parquet(self._snapshot(version))))

    def state(self, spark: SparkSession) -> DataFrame:
        """The counters now."""
        return counter_state(self.log(spark))

    def compact(self, spark: SparkSession, through: int) -> None:
        """Make the state after a batch the snapshot.  A repeat, also after a failure half way, leaves the same."""
        if through <= self.version(spark):
            return
        state = counter_state(self.log(spark, through)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE])
        state.write.mode("overwrite").parquet(self._snapshot(through))
        spark.createDataFrame([(through,)], _VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def prune(self, spark: SparkSession, keep: int) -> None:
        """Delete snapshots and batches that only readers from before version ``keep`` would open."""
        rows = spark.read.schema(_VERSIONS).parquet(f"{self.path}/versions").where(F.col("version") < keep).collect()
        for r in rows:
            remove(spark, self._snapshot(r.version))
        old = read_ledger(spark, self._ledger(), CHANGES, queries=True).where((F.col("batch") >= 0) & (F.col("batch") <= keep)).select("query", "batch").distinct()
        for r in old.collect():
            remove(spark, f"{self._ledger()}/query={r.query}/batch={r.batch}")
