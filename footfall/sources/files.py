"""Folders in whatever store the paths name, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
