"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footfall.session import scratch_path
from footfall.sources.files import remove

# White space between words: blank and the control characters 9 to 13.
BREAKS = r"[ \t-\r]+"
# Bound of the rows that a bucket filter may broadcast.
FILTER_BUCKETS = 1 << 18


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS, -1), lambda w: w != "")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result below the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running tasks only.  Shuffle
    files go when the driver's JVM collects the plans that made them; asked to do so here,
    it frees those of a finished step before the next one fills the disks.
    """
    return step(df, label)[0]


def step(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``materialize`` with the folder, for ``release`` once nothing reads the step any more."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, label), df.schema
    df.write.parquet(path)
    del df
    # The first call finds the plan still held by the thread that ran it.
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete steps whose successors are written."""
    for path in paths:
        remove(spark, path)


def identified(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with __doc, the key as a long or the largest one if it is null or no whole number, and __row.

    __row tells rows apart that share a key; it is 0 where none do.  Such rows are written once, so that their numbers stay.
    """
    tagged = docs.withColumn("__doc", F.coalesce(F.col(f"`{key}`").try_cast("long"), F.lit((1 << 63) - 1)))
    shared = materialize(tagged.groupBy("__doc").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__doc"), "shared_keys")
    if shared.isEmpty():
        return tagged.withColumn("__row", F.lit(0).cast("long"))
    again = tagged.join(shared, "__doc", "left_semi").withColumn("__row", F.monotonically_increasing_id() + 1)
    single = tagged.join(shared, "__doc", "left_anti").withColumn("__row", F.lit(0).cast("long"))
    return single.unionByName(materialize(again, "shared_rows"))


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BUCKETS))


def bucket_split(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into those whose key may occur in ``ids`` and the rest.

    ``ids`` (column ``key``) is reduced to hash buckets, at most FILTER_BUCKETS
    rows, and only those are broadcast.  The first part has every row with a key
    in ``ids`` and some others; the second part surely has none, so it needs no
    shuffle to be joined with ``ids``.
    """
    buckets = materialize(ids.select(_bucket(F.col(key)).alias("__bucket")).distinct(), "buckets")
    tagged = df.withColumn("__bucket", F.coalesce(_bucket(F.col(key)), F.lit(-1)))
    near = tagged.join(F.broadcast(buckets), "__bucket", "left_semi").drop("__bucket")
    far = tagged.join(F.broadcast(buckets), "__bucket", "left_anti").drop("__bucket")
    return near, far
