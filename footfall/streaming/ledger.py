"""Folders per query and batch: a sink whose writes can be repeated.

A micro-batch may be handed over twice after a failure.  Each batch of a query
owns one folder and overwrites it, so a repeat leaves the same rows.  A query
with a fresh checkpoint is another query: it does not overwrite what an earlier
one wrote, and it is refused, for it would read its source a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_NO_QUERY = "none"


def _folders(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("query", T.StringType()), T.StructField("batch", T.LongType())])


def _query_of(df: DataFrame) -> str:
    """Id of the streaming query that hands over a micro-batch."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or _NO_QUERY


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    query = _query_of(df)
    if batch_id == 0:
        others = df.sparkSession.read.schema(_folders(T.StructType())).parquet(path).where((F.col("batch") >= 0) & (F.col("query") != query))
        if not others.isEmpty():
            raise RuntimeError(f"the ledger {path} belongs to another query; use its checkpoint or a new ledger")
    df.write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")


def open_ledger(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make an empty ledger readable before its first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/query={_NO_QUERY}/batch=-1")


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, queries: bool = False) -> DataFrame:
    """All rows, or those of the batches before one; with ``queries`` the writing query as well."""
    df = spark.read.schema(_folders(schema)).parquet(path)
    df = df if queries else df.drop("query")
    return df if before is None else df.where(F.col("batch") < before)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """What one batch wrote."""
    return read_ledger(spark, path, schema).where(F.col("batch") == batch_id)
