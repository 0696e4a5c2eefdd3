"""Partial aggregates per project and day, kept beside the tables and refreshed where files changed.

A table's listing tells which days have other files than at the last refresh; only those days are read again, and
their partials replace the old ones folder by folder.  Partials add up: counts and sums by
addition, users by the set of them, so the overview of any whole days is exact.  What was
seen is noted after the partials are written; a refresh that failed half way is simply done again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.operators.metrics import overview_row
from footfall.ranges import TimeRange, in_project
from footfall.schemas import struct
from footfall.sources.files import remove
from footfall.sources.tables import TableStore

_SEEN = struct("project_id string, dt string, signature string, version bigint")
_PARTS = {
    "events": struct("user_id string, events bigint, project_id string, dt date"),
    "sessions": struct("sessions bigint, duration_ms bigint, durations bigint, project_id string, dt date"),
    "devices": struct("active_day date, devices bigint, project_id string, dt date"),
}


def _partials(rows: DataFrame, table: str) -> DataFrame:
    day = ["project_id", "dt"]
    if table == "events":
        return rows.groupBy(*day, "user_id").agg(F.count(F.lit(1)).alias("events"))
    if table == "sessions":
        return rows.groupBy(*day).agg(F.count(F.lit(1)).alias("sessions"), F.sum("session_duration_ms").alias("duration_ms"), F.count("session_duration_ms").alias("durations"))
    return rows.groupBy(*day, F.to_date("last_active_at").alias("active_day")).agg(F.count(F.lit(1)).alias("devices"))


@dataclass(frozen=True)
class Rollups:
    store: TableStore
    path: str

    def _part(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _seen(self, table: str) -> str:
        return f"{self.path}/seen/{table}"

    def create(self, spark: SparkSession) -> None:
        for table, schema in _PARTS.items():
            spark.createDataFrame([], schema).write.mode("overwrite").partitionBy("project_id", "dt").parquet(self._part(table))
            spark.createDataFrame([], _SEEN).write.mode("overwrite").parquet(self._seen(table))

    def listing(self, spark: SparkSession, table: str) -> DataFrame:
        """(project_id, dt, signature) of the files of every day; no file is opened."""
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.store.path(table))
        part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name)
        rows = files.select(part("project_id"), part("dt"), F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)").alias("h"))
        return rows.where("dt <> ''").groupBy("project_id", "dt").agg(F.concat_ws("-", F.count(F.lit(1)), F.sum("h")).alias("signature"))

    def changed(self, spark: SparkSession, table: str) -> DataFrame:
        """(project_id, dt, signature) of the days whose files changed; a null signature is a day that is gone."""
        seen = spark.read.schema(_SEEN).parquet(self._seen(table)).groupBy("project_id", "dt").agg(F.max_by("signature", "version").alias("before"))
        both = self.listing(spark, table).join(seen, ["project_id", "dt"], "full")
        return both.where(~F.col("signature").eqNullSafe(F.col("before"))).select("project_id", "dt", "signature")

    def refresh(self, spark: SparkSession) -> dict[str, int]:
        """Bring the partials up to date; the number of days read again, by table."""
        done = {}
        for table in _PARTS:
            found = self.changed(spark, table)
            path = f"{self.path}/changes/{table}"
            found.write.mode("overwrite").parquet(path)
            changed = spark.read.schema(found.schema).parquet(path)
            days = [r.dt for r in changed.where(F.col("signature").isNotNull()).select("dt").distinct().collect()]
            done[table] = changed.count()
            if not done[table]:
                continue
            # The dates prune the folders, the join the projects inside them.
            rows = self.store.read(spark, table).where(F.col("dt").isin([F.lit(d).cast("date") for d in days]))
            fresh = changed.where(F.col("signature").isNotNull()).select("project_id", F.col("dt").cast("date").alias("dt"))
            parts = _partials(rows.join(fresh, ["project_id", "dt"], "left_semi"), table).select(*_PARTS[table].fieldNames())
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "dt").parquet(self._part(table))
            for r in changed.where(F.col("signature").isNull()).toLocalIterator():
                remove(spark, f"{self._part(table)}/project_id={r.project_id}/dt={r.dt}")
            last = spark.read.schema(_SEEN).parquet(self._seen(table)).agg(F.max("version")).first()[0]
            changed.withColumn("version", F.lit((last or 0) + 1).cast("bigint")).write.mode("append").parquet(self._seen(table))
        return done

    def _days(self, spark: SparkSession, table: str, project_id: str) -> DataFrame:
        return in_project(spark.read.schema(_PARTS[table]).parquet(self._part(table)), project_id)

    def overview(self, spark: SparkSession, project_id: str, rng: TimeRange) -> DataFrame:
        """``metrics.overview`` from the partials of whole days; other ranges are an error."""
        edges = [rng.start, rng.end]
        if any(e != e.replace(hour=0, minute=0, second=0, microsecond=0) for e in edges):
            raise ValueError("rollups answer whole days only")
        low, high = (F.lit(e.date()) for e in edges)
        inside = lambda c: (F.col(c) >= low) & (F.col(c) < high)
        total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
        d = self._days(spark, "devices", project_id).agg(
            total("devices").alias("devices_total"), total(F.when(inside("active_day"), F.col("devices"))).alias("devices_active")
        )
        mean: Column = F.sum("duration_ms").cast("double") / F.nullif(F.sum("durations"), F.lit(0))
        s = self._days(spark, "sessions", project_id).where(inside("dt")).agg(total("sessions").alias("sessions_total"), F.coalesce(mean, F.lit(0.0)).alias("avg_ms"))
        e = self._days(spark, "events", project_id).where(inside("dt")).agg(F.count_distinct("user_id").alias("users_active"), total("events").alias("events_total"))
        return overview_row(d, s, e)
