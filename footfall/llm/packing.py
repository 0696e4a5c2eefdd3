"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

State: pieces not placed yet and sequences with a gap.  Pieces above half the
capacity open a sequence each.  The others follow in bands of falling length.  A
round range-sorts the pieces of the band and all gaps by size and

1. sweeps every range by itself: each piece, longest first, takes its successor,
   the smallest gap it fits in, and what is left of the gap stays in the sweep;
2. hands the pieces that found none to the gaps of higher ranges, nearest range
   first.  Pieces and gaps of a range are ranked, and ranks decide between pieces
   that want one range: only the counts of the ranges, a row for each, go through the
   driver;
3. updates the gaps and repeats until a round places nothing.  No gap holds a
   piece of the band then, and what remains opens sequences.

Every round is written to the shared folder, so its sweep is not run again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from footfall.llm.common import materialize
from footfall.llm.tokens import TOKENIZER, word_tokenizer

CAPACITY = 1024
END_ID = 2
# Rows that a task sorts and sweeps.
SWEEP_ROWS = 200_000
# Bands by halving below half the capacity; the last one takes all shorter pieces.
BANDS = 4
_TEXTS_AT_ONCE = 1024
_SWEPT = "kind string, part int, rank long, id long, size int, used int, sequence_id long, offset int, prefix long"
_PLACED = ("id", "sequence_id", "offset")


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32, ids) of all documents.

    A document is its ids and END_ID; a null text is empty.  Only documents above
    the capacity are cut, and only their first piece is shorter than it.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_tokenizer(tokenizer)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for start in range(0, len(batch), _TEXTS_AT_ONCE):
                some = batch.iloc[start : start + _TEXTS_AT_ONCE]
                rows = []
                for name, ids in zip(some["key"], words.ids([b.decode("utf-8", "replace") if b else "" for b in some["text"]])):
                    ids += end
                    total = len(ids) // 4
                    first = total % capacity or min(total, capacity)
                    edges = [0, *range(first, total + 1, capacity)]
                    for piece, (lo, hi) in enumerate(zip(edges, edges[1:])):
                        part = ids[4 * lo : 4 * hi]
                        rows.append((name, piece, lo, hi - lo, zlib.crc32(part), part))
                yield pd.DataFrame(rows, columns=["key", "piece", "start", "length", "ids_crc32", "ids"])

    # Keys travel as text: a null beside a large number would turn it into a float.
    slim = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    found = slim.mapInPandas(cut, "key string, piece int, start long, length long, ids_crc32 long, ids binary")
    return found.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


class _Shelf:
    """Gaps by size."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.at: dict[int, list[int]] = {}

    def put(self, size: int, gap: int) -> None:
        if size not in self.at:
            insort(self.sizes, size)
            self.at[size] = []
        self.at[size].append(gap)

    def take(self, size: int) -> tuple[int, int] | None:
        """The smallest gap of at least this size."""
        k = bisect_left(self.sizes, size)
        if k == len(self.sizes):
            return None
        found = self.sizes[k]
        gap = self.at[found].pop()
        if not self.at[found]:
            del self.at[found], self.sizes[k]
        return found, gap


def _swept(frame: pd.DataFrame, part: int, opens: int) -> pd.DataFrame:
    """Best fit inside one range; with ``opens`` pieces without a gap open sequences of that capacity.

    opens is 0 in a sweep.  Results by kind: placed (a piece), piece and gap (left
    for other ranges, ranked), low (a gap below the range).
    """
    floor = int(frame["size"].min())
    is_gap = frame["kind"].to_numpy() == "gap"
    gaps, pieces = frame[is_gap], frame[~is_gap]
    left, used, names = gaps["size"].tolist(), gaps["used"].tolist(), gaps["id"].tolist()
    shelf = _Shelf()
    for k, size in enumerate(left):
        shelf.put(size, k)
    placed, over = [], []
    for size, name in sorted(zip(pieces["size"].tolist(), pieces["id"].tolist()), key=lambda x: (-x[0], x[1])):
        found = shelf.take(size)
        if found:
            gap = found[1]
        elif opens:
            gap = len(left)
            left.append(opens)
            used.append(0)
            names.append((part << 33) + gap)
        else:
            over.append((name, size))
            continue
        placed.append((name, size, names[gap], used[gap]))
        left[gap] -= size
        used[gap] += size
        if left[gap] >= floor:
            shelf.put(left[gap], gap)
    out, prefix = [("placed", part, 0, n, s, 0, q, o, 0) for n, s, q, o in placed], 0
    for rank, (name, size) in enumerate(over):
        out.append(("piece", part, rank, name, size, 0, None, None, prefix))
        prefix += size
    rank = 0
    for name, size, start in zip(names, left, used):
        if size > 0:
            inside = size >= floor
            out.append(("gap" if inside else "low", part, rank if inside else -1, name, size, start, None, None, 0))
            rank += inside
    # Built by column: rows with a missing value would turn large ids into floats.
    columns = zip(*out) if out else [[]] * 9
    kinds = {"kind": object, "sequence_id": "Int64", "offset": "Int32"}
    return pd.DataFrame({name: pd.array(list(c), dtype=kinds.get(name, "int64")) for name, c in zip((f.split()[0] for f in _SWEPT.split(", ")), columns)})


def _sweep(items: DataFrame, ranges: int, opens: int = 0) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            yield _swept(pd.concat(frames, ignore_index=True), TaskContext.get().partitionId(), opens)

    spread = items.repartitionByRange(ranges, F.col("size").desc(), F.xxhash64("kind", "id"))
    return materialize(spread.mapInPandas(run, _SWEPT), "swept")


def _claims(swept: DataFrame) -> list[tuple]:
    """Which ranks of a range's pieces go to which ranks of a higher range's gaps.

    Rows (part, low, high, gap_part, gap_low, fold): piece ranks [low, high) go to gap
    ranks from gap_low on, ``fold`` pieces each.  Ranges are taken from the largest
    sizes down and the nearest free gaps first, so no piece takes a gap that a
    longer one wants.  At most two claims per range.
    """
    rows = swept.where("kind in ('piece', 'gap')").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("low"), F.max("size").alias("high")).collect()
    by = {(r.part, r.kind): r for r in rows}
    free: list[list[int]] = []
    claims = []
    for part in sorted({r.part for r in rows}):
        pieces, gaps = by.get((part, "piece")), by.get((part, "gap"))
        at = 0
        while pieces and at < pieces.n and free:
            gap_part, start, count, smallest = free[-1]
            fold = max(1, smallest // pieces.high)
            taken = min(pieces.n - at, count * fold)
            claims.append((part, at, at + taken, gap_part, start, fold))
            at += taken
            full = -(-taken // fold)
            free[-1][1:3] = [start + full, count - full]
            if not free[-1][2]:
                free.pop()
        if gaps:
            free.append([part, 0, gaps.n, gaps.low])
    return claims


def _crossed(swept: DataFrame, claims: list[tuple]) -> DataFrame:
    """Pieces left by a sweep, with the sequence and offset they get elsewhere, if any."""
    table = swept.sparkSession.createDataFrame(claims, "c_part int, low long, high long, gap_part int, gap_low long, fold long")
    left = swept.where("kind = 'piece'").select("part", "rank", "id", "size", "prefix")
    claimed = left.join(F.broadcast(table), (F.col("part") == F.col("c_part")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    claimed = claimed.withColumn("gap_rank", F.col("gap_low") + F.floor((F.col("rank") - F.col("low")) / F.col("fold")))
    gaps = swept.where("kind = 'gap'").select(F.col("part").alias("g_part"), F.col("rank").alias("g_rank"), F.col("id").alias("sequence_id"), "used")
    met = claimed.where("gap_rank is not null").join(gaps, (F.col("gap_part") == F.col("g_part")) & (F.col("gap_rank") == F.col("g_rank")))
    run = Window.partitionBy("sequence_id")
    met = met.withColumn("offset", (F.col("used") + F.col("prefix") - F.min("prefix").over(run)).cast("int"))
    missed = claimed.where("gap_rank is null").select("id", "size", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("int").alias("offset"))
    return materialize(met.select("id", "size", "sequence_id", "offset").unionByName(missed), "crossed")


def _count(df: DataFrame) -> int:
    return df.count()


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (id, size) to rows (id, sequence_id, offset).

    ids are distinct longs, sizes between 1 and the capacity.  Offsets are
    gapless from 0 in every sequence.
    """
    spark: SparkSession = items.sparkSession
    items = items.select("id", F.col("size").cast("int").alias("size"))
    large = items.where(F.col("size") > capacity // 2).withColumn("sequence_id", F.monotonically_increasing_id())
    large = materialize(large.withColumn("offset", F.lit(0)), "large")
    placed = [large.select(*_PLACED)]
    gap = lambda df: df.select(F.lit("gap").alias("kind"), F.col("sequence_id").alias("id"), "size", "used")
    gaps = gap(large.where(F.col("size") < capacity).select("sequence_id", (F.lit(capacity) - F.col("size")).alias("size"), F.col("size").alias("used")))
    edges = [capacity // 2 >> k for k in range(BANDS)] + [0]
    opened = 0
    for top, low in zip(edges, edges[1:]):
        todo = items.where((F.col("size") <= top) & (F.col("size") > low))
        count = _count(todo)
        while count:
            # Gaps no piece of the band fits in wait for shorter bands.
            idle, ready = gaps.where(F.col("size") <= low), gaps.where(F.col("size") > low)
            free = _count(ready)
            if not free:
                break
            work = todo.select(F.lit("piece").alias("kind"), "id", "size", F.lit(0).alias("used")).unionByName(ready)
            swept = _sweep(work, -(-(count + free) // SWEEP_ROWS))
            placed.append(swept.where("kind = 'placed'").select(*_PLACED))
            rest = swept.where("kind in ('gap', 'low')").select("kind", F.col("id").alias("sequence_id"), "size", "used")
            claims = _claims(swept)
            if claims:
                crossed = _crossed(swept, claims)
                placed.append(crossed.where("sequence_id is not null").select(*_PLACED))
                taken = crossed.where("sequence_id is not null").groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").cast("int").alias("more"))
                rest = rest.join(taken, F.col("sequence_id") == F.col("id"), "left").withColumn("more", F.coalesce("more", F.lit(0)))
                rest = rest.select("sequence_id", (F.col("size") - F.col("more")).alias("size"), (F.col("used") + F.col("more")).alias("used")).where("size > 0")
                todo = crossed.where("sequence_id is null").select("id", "size")
            else:
                todo = swept.where("kind = 'piece'").select("id", "size")
            gaps = materialize(idle.unionByName(gap(rest)), "gaps")
            left = _count(todo)
            if left == count:
                break
            count = left
        if count:
            opened += 1
            work = todo.select(F.lit("piece").alias("kind"), "id", "size", F.lit(0).alias("used"))
            swept = _sweep(work, -(-count // SWEEP_ROWS), capacity)
            name = (F.lit(opened << 56) + F.col("sequence_id")).alias("sequence_id")
            placed.append(swept.where("kind = 'placed'").select("id", name, "offset"))
            fresh = swept.where("kind in ('gap', 'low')").select((F.lit(opened << 56) + F.col("id")).alias("sequence_id"), "size", "used")
            gaps = gaps.unionByName(gap(fresh))
    return reduce(DataFrame.unionByName, placed)


def packed_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset.  Repeated rows are pieces of their own."""
    named = materialize(pieces.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    places = pack(named.select(F.col("__id").alias("id"), F.col("length").alias("size")), capacity)
    return named.join(places, named["__id"] == places["id"]).drop("__id", "id")
