"""Mixing sources to target weights.

Word counts are added up per source; every source gets a target, its repetition
rate is target / size, and each document is emitted floor(rate) times plus one
more time if a draw seeded by its id falls below the fraction of the rate.
Column functions alone.  The table of sources has one row per source; it is
broadcast only after it was counted and found small, else it is joined by a
shuffle, where AQE splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import materialize, words_of

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MAX_REPEATS = 2
SEED = "mix-1"
# Rows of the source table up to which it is broadcast.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.size(words_of(text)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Rows (source, size) to one row per source with target and rate.

    Sources in code point order, null last, take the weights in turn and share
    ``share_percent`` of all sizes.  A target stops at ``max_repeats`` times the
    size of its source and the excess is shared by weight among the others.  Put
    in order of cap / weight the sources at their cap come first, so the level
    of the others follows from running sums: it is the first one that no later
    source's cap undercuts.  The windows run over one row per source.
    A source without words has target 0 and rate 1.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share_percent) / F.lit(100.0))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level_here", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("settled", F.col("level_here") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min_by("level_here", F.when(F.col("settled"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNotNull(), F.col("source")))).over(everything))
    )
    target = F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0).alias("rate"))


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the key alone; a null key draws like the text 'null'."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _with_targets(rows: DataFrame, source: Column, targets: DataFrame) -> DataFrame:
    targets = materialize(targets.withColumnsRenamed({c: f"__{c}" for c in targets.columns}), "sources")
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(targets) if small else targets, source.eqNullSafe(targets["__source"]), "left")


def plan_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **shares) -> DataFrame:
    """Every row of ``docs`` in __row, with __size, its source's figures and __copies.

    Rows with one key draw alike.  Null and empty texts have size 0 and are
    emitted like the other documents of their source.
    """
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    df = df.withColumn("__size", size_of(F.col(f"__row.`{text}`")))
    targets = source_targets(docs.select(F.col(f"`{source}`").alias("source"), size_of(F.col(f"`{text}`")).alias("size")), **shares)
    df = _with_targets(df, F.col(f"__row.`{source}`"), targets)
    extra = F.when(draw(F.col(f"__row.`{key}`"), seed) < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    return df.withColumn("__copies", (F.floor("__rate") + extra).cast("int"))


def emit(plan: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as planned."""
    copies = plan.where(F.col("__copies") > 0).select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    return copies.select("__row.*")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Documents repeated to the target weights, with their own columns only."""
    return emit(plan_mix(docs, **options))
