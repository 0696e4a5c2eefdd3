"""Stored tables: Parquet, partitioned by project and date."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footfall import schemas
from footfall.functions.text import project_id as clean_column
from footfall.ranges import TimeRange, clean_project_id, in_project

_IDENTIFIER = re.compile(r"[a-z0-9_]{1,63}")
_PROJECT = re.compile(r"[a-z0-9_-]{1,50}")
_PREFIX = re.compile(r"[a-z0-9_]{0,40}")


def check_project_id(project_id: str) -> str:
    cleaned = clean_project_id(project_id)
    if not _PROJECT.fullmatch(cleaned):
        raise ValueError(f"malformed project id: {project_id!r}")
    return cleaned


def table_name(base: str, prefix: str = "") -> str:
    """Checked table name of a project: prefix plus base name."""
    name = f"{prefix}{base}"
    if not _PREFIX.fullmatch(prefix) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"malformed table name: {name!r}")
    return name


@dataclass(frozen=True)
class TableStore:
    """The tables of a deployment below one root folder."""

    root: str
    prefix: str = ""

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table_name(table, self.prefix)}"

    def schema(self, table: str) -> T.StructType:
        base = schemas.PROJECT_TABLES[table]
        if table not in schemas.PARTITION_TIME:
            return base
        return T.StructType(base.fields + [T.StructField("dt", T.DateType())])

    def create(self, spark: SparkSession) -> None:
        """Create the folders of all tables, so that an empty table can be read."""
        for table in schemas.PROJECT_TABLES:
            empty = spark.createDataFrame([], schemas.PROJECT_TABLES[table])
            empty.write.mode("append").parquet(self.path(table))

    def read(
        self,
        spark: SparkSession,
        table: str,
        project_id: str | None = None,
        column: str | None = None,
        rng: TimeRange | None = None,
    ) -> DataFrame:
        """A table, one project of it, or a range of one project."""
        df = spark.read.schema(self.schema(table)).parquet(self.path(table))
        if project_id is None:
            return df
        return in_project(df, check_project_id(project_id), column, rng)

    def append(self, df: DataFrame, table: str, spread: bool = True) -> None:
        """Append rows, one folder per project and date.

        ``spread`` adds a rebalance on the partition columns: tiny folders are
        written by few tasks and a hot project-day is cut into several.
        """
        self.write(df, table, self.path(table), "append", spread)

    def write(self, df: DataFrame, table: str, path: str, mode: str, spread: bool = True) -> None:
        names = schemas.PROJECT_TABLES[table].fieldNames()
        out = df.select(*[F.col(n).cast(schemas.PROJECT_TABLES[table][n].dataType).alias(n) for n in names])
        folders = ["project_id"]
        if table in schemas.PARTITION_TIME:
            out = out.withColumn("dt", F.to_date(schemas.PARTITION_TIME[table]))
            folders.append("dt")
        if spread:
            out = out.hint("rebalance", *[F.col(f) for f in folders])
        out.write.mode(mode).partitionBy(*folders).parquet(path)


def require_active(projects: DataFrame, project_id: str) -> str:
    """The cleaned id of a known, active project; anything else is an error."""
    cleaned = check_project_id(project_id)
    found = projects.where(F.col("project_id") == cleaned).select("is_active").head(1)
    if not found:
        raise ValueError(f"unknown project: {cleaned}")
    if not found[0][0]:
        raise ValueError(f"inactive project: {cleaned}")
    return cleaned


def project_reason(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """Requests with the cleaned project id and a ``reason``; null means the project may be read.

    The registry has one row per project and is joined, so a project asked for by most requests is
    split at run time.
    """
    known = projects.groupBy(F.col("project_id").alias("known_id")).agg(F.max(F.coalesce("is_active", F.lit(False))).alias("active"))
    asked = requests.withColumn("project_id", clean_column(F.col("project_id")))
    reason = (
        F.when(F.coalesce(F.col("project_id") == "", F.lit(True)), "missing_project_id")
        .when(~F.col("project_id").rlike(f"^{_PROJECT.pattern}$"), "malformed_project_id")
        .when(F.col("active").isNull(), "unknown_project")
        .when(~F.col("active"), "inactive_project")
    )
    return asked.join(known, F.col("project_id") == F.col("known_id"), "left").withColumn("reason", reason).drop("known_id", "active")


def of_active_projects(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of all active projects."""
    active = projects.where(F.coalesce(F.col("is_active"), F.lit(False))).select("project_id")
    return df.join(active, "project_id", "left_semi")


def event_types(events: DataFrame, project_id: str) -> DataFrame:
    """Distinct event types of a project."""
    return in_project(events, project_id).select("event_type").distinct()
