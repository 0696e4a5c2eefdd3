"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import materialize


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component): every linked node with the smallest node it reaches.

    Alternates the large-star and small-star steps until the links no longer
    change.  Each step is a minimum per node, which combines on the map side,
    joined back to the links; AQE splits a hot node.  Every round is written to
    the shared folder; the driver sees a count and a checksum.  Null ends and
    links from a node to itself are ignored.
    """
    ends = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = materialize(ends.where("u <> v").distinct(), "links")
    before = _checksum(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _checksum(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _checksum(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.s
