"""Rows of many batches, kept so that a reader opens a bounded part of them.

Every batch leaves one run of its rows.  Whenever ``fan`` runs of a level are full they are merged
into one run of the next level, so there are at most (fan - 1) runs per level and a row is
rewritten once per level.  Which runs hold the batches before one follows from its
number alone: a repeated batch reads the same runs and overwrites its own.

A run has a folder per leading digits of a hash, so only the digits that a reader asks for are opened; inside,
files are cut and sorted by that hash and carry Bloom filters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from footfall.sources.files import remove

FAN = 8
DIGITS = 1
ROWS_PER_FILE = 2_000_000


@dataclass(frozen=True)
class Runs:
    """``hashed`` is a column in hex digits; ``merge`` reduces the rows of several runs to those of one."""

    path: str
    schema: T.StructType
    hashed: str
    merge: Callable[[DataFrame], DataFrame] = lambda rows: rows
    fan: int = FAN
    digits: int = DIGITS

    def _run(self, level: int, end: int) -> str:
        return f"{self.path}/level={level}/end={end}"

    def _prefix(self) -> Column:
        return F.substring(self.hashed, 1, self.digits)

    def runs_before(self, batch: int) -> list[tuple[int, int]]:
        """(level, end) of the runs that hold all batches before one: its digits to the base ``fan``."""
        level, out, end = 0, [], 0
        while self.fan ** (level + 1) <= batch:
            level += 1
        for k in range(level, -1, -1):
            size = self.fan**k
            while end + size <= batch:
                end += size
                out.append((k, end))
        return out

    def _read(self, spark: SparkSession, runs: list[tuple[int, int]]) -> DataFrame:
        stored = T.StructType(self.schema.fields + [T.StructField("prefix", T.StringType())])
        if not runs:
            return spark.createDataFrame([], stored)
        return spark.read.schema(stored).option("basePath", self.path).parquet(*[self._run(*r) for r in runs]).select(*stored.fieldNames())

    def _write(self, rows: DataFrame, path: str) -> None:
        rows = rows.select(*self.schema.fieldNames()).withColumn("prefix", self._prefix())
        files = -(-rows.count() // ROWS_PER_FILE)
        ordered = rows.repartitionByRange(max(1, files), "prefix", self.hashed).sortWithinPartitions("prefix", self.hashed)
        ordered.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{self.hashed}", "true").partitionBy("prefix").parquet(path)

    def rows(self, spark: SparkSession, batch: int, asked: DataFrame | None = None) -> DataFrame:
        """Rows of the batches before one; with ``asked`` only those in folders that its hashes can be in."""
        found = self._read(spark, self.runs_before(batch))
        if asked is not None:
            # As many values as there are digits, whatever the batch.
            digits = [r[0] for r in asked.select(self._prefix()).distinct().collect()]
            found = found.where(F.col("prefix").isin(digits))
        return found.drop("prefix")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Store the rows of a batch and merge what is full."""
        spark, end = rows.sparkSession, batch + 1
        self._write(rows, self._run(0, end))
        level = 1
        while end % self.fan**level == 0:
            size = self.fan ** (level - 1)
            parts = [(level - 1, end - k * size) for k in range(self.fan - 1, -1, -1)]
            self._write(self.merge(self._read(spark, parts).drop("prefix")), self._run(level, end))
            level += 1

    def prune(self, spark: SparkSession, batch: int) -> None:
        """Delete the runs that were merged in the batch before this one; it has been committed, so nothing reads them again."""
        level = 1
        while batch and batch % self.fan**level == 0:
            size = self.fan ** (level - 1)
            for k in range(self.fan):
                remove(spark, self._run(level - 1, batch - k * size))
            level += 1
