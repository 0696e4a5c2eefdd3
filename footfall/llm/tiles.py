"""Cutting hot groups of a self-join into tiles of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import materialize

# Rows of the table of hot keys up to which it is broadcast.
BROADCAST_KEYS = 100_000


def hot_groups(rows: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """The groups above the bound and the number of parts of each, for ``tiled``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound)
    return materialize(counts.select(*keys, F.ceil(F.col("__n") / bound).cast("int").alias("__parts")), "hot")


def tiled(rows: DataFrame, keys: list[str], spread: str, bound: int, hot: DataFrame | None = None) -> DataFrame:
    """Rows with columns part, tile_a, tile_b (tile_a <= part or tile_b = part).

    A group with n rows is cut into ceil(n / bound) parts by a hash of
    ``spread``; a row goes to every tile that pairs its part with another, so
    each pair of rows meets in exactly one tile and no tile has more than about
    two parts.  Groups within the bound are one tile and are not multiplied.  ``hot`` are the
    groups that hot_groups found, also in more rows than these.
    """
    hot = hot_groups(rows, keys, bound) if hot is None else hot
    found = hot.limit(BROADCAST_KEYS + 1).count()
    if not found:
        zero = F.lit(0)
        return rows.withColumns({"part": zero, "tile_a": zero, "tile_b": zero})
    joined = rows.join(F.broadcast(hot) if found <= BROADCAST_KEYS else hot, keys, "left")
    joined = joined.withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    joined = joined.withColumn("part", F.pmod(F.xxhash64(spread, F.lit(7)), F.col("__parts")).cast("int"))
    joined = joined.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    return joined.withColumns({"tile_a": F.least("part", "__other"), "tile_b": F.greatest("part", "__other")}).drop("__parts", "__other")
