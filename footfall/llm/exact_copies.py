"""Exact dedup of texts by a 128-bit hash, with the bytes compared.

Texts are equal if they are identical after each run of white space has become one blank.

1. Rows are counted by the MD5 of that text; only hashes and ids are shuffled.
2. Rows meet the count and the smallest id of their hash.  Those whose hash
   occurs once are settled.
3. In the other groups every row's bytes are compared with those of the row with the
   smallest id.  A group is never gathered: it is a join of its rows with one row, which
   AQE splits where a group is hot.
4. Rows that differ from it, so a collision of hashes, are grouped by hash and bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import BREAKS, materialize

_OWN = ("__hash", "__sha256", "__n", "__first", "__row")


def normalised(text: Column) -> Column:
    """The text with one blank for each run of white space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BREAKS, " ")


def content_hash(text: Column) -> Column:
    """MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def _order(key: str) -> Column:
    # The smallest key first, a null one last.
    return F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("key"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``docs`` with __keep, __group_size, __kept and __sha256 (of the normalised text, lowercase hex).

    __keep is the smallest key of the rows with an equal text and __kept is true for the row that
    stays, one for every text.  A null text is empty and equal to an empty one.  A null key counts as
    the largest: __keep is null only where all keys of the group are.  Of rows that repeat the smallest
    key, wholly equal ones included, one stays.  ``digest`` may be any hash: a poor one costs time,
    not right results.  All columns stay, but for names that begin with two underscores; an empty table
    gives an empty result.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = normalised(F.col(f"`{text}`"))
    tagged = docs.withColumn("__hash", digest(plain))
    groups = tagged.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"), F.min(_order(key)).alias("__least")).where("__n > 1")
    # The groups grow with the rows, so they are met by shuffle at any size.
    met = tagged.join(materialize(groups, "hash_groups").hint("merge"), "__hash", "left")
    # Row numbers are taken from the written table, so they stay the same however often it is read.
    found = met.select(
        *names, "__hash", F.sha2(plain.cast("binary"), 256).alias("__sha256"), F.coalesce("__n", F.lit(1)).alias("__n"),
        F.coalesce(_order(key) == F.col("__least"), F.lit(True)).alias("__first"), F.monotonically_increasing_id().alias("__row"),
    )
    found = materialize(found, "hashed_texts")
    single = found.where("__n = 1").select(
        *names, F.col(f"`{key}`").alias("__keep"), F.lit(1).cast("long").alias("__group_size"), F.lit(True).alias("__kept"), "__sha256"
    )
    decided = _compared(found.where("__n > 1"), key, plain)
    several = found.where("__n > 1").drop("__n", "__first", "__hash").join(decided, "__row")
    return single.unionByName(several.select(*names, "__keep", "__group_size", "__kept", "__sha256"))


def _compared(found: DataFrame, key: str, plain: Column) -> DataFrame:
    """Rows (__row, __keep, __group_size, __kept) of groups of equal hashes."""
    # Aggregates are written before they are joined: AQE splits a hot group only if nothing stands between join and shuffle.
    first = materialize(found.where("__first").groupBy("__hash").agg(F.min_by(plain, "__row").alias("__bytes")), "first_texts")
    same = plain == F.col("__bytes")
    met = found.join(first, "__hash").select("__row", "__hash", _order(key).alias("__order"), F.when(~same, plain).alias("__other"))
    met = materialize(met, "compared_texts")
    place = F.struct("__order", "__row")
    # __other is null for the class of the first row and the bytes themselves for any other class.
    classes = met.groupBy("__hash", "__other").agg(F.count(F.lit(1)).alias("__group_size"), F.min(place).alias("__lead"))
    classes = classes.withColumnsRenamed({"__hash": "__hash_b", "__other": "__other_b"})
    classes = materialize(classes, "text_classes")
    joined = met.join(classes, (F.col("__hash") == F.col("__hash_b")) & F.col("__other").eqNullSafe(F.col("__other_b")))
    return joined.select(
        "__row", F.col("__lead.__order.key").alias("__keep"), "__group_size", (F.col("__row") == F.col("__lead.__row")).alias("__kept")
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay."""
    return exact_groups(docs, key, text).where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])
