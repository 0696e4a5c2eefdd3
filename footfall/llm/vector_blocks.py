"""Near-duplicate vectors by a pigeonhole join over subspaces.

Two unit vectors with cosine c are sqrt(2 - 2c) apart.  A fixed rotation spreads
the distance over all coordinates; the rotated vector is cut into blocks of few
dimensions, and a pair within the distance is within the block's share of the
squared distance in at least one block.  Every block is a range join: vectors
meet in cells of its first two coordinates (a vector near a lower border is a
guest in the cell below), are compared in the block, and a pair that passes is
verified by its cosine there and then.  A pair belongs to its first passing
block and to one cell, so it is counted once and never sent on: tasks return
counts and components.  Equal vectors are one class throughout, so copies are
not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.arrays import group_numbers, local_labels, whole_groups
from footfall.llm.common import materialize
from footfall.llm.components import components
from footfall.llm.tiles import tiled

THRESHOLD = 0.98
BLOCK_DIMS = 8
# A cell is this many block radii wide.
CELL_RADII = 4.0
# Rows of a cell that are compared in one tile.
CELL_ROWS = 2048
TASK_ROWS = 8_192
PAIRS_AT_ONCE = 1 << 16
SEED = 20
# Slack of the block test; pairs it lets through are verified exactly.
SLACK = 1e-9
_KEYS = ["label", "dims", "block", "cell_a", "cell_b", "tile_a", "tile_b"]


def usable(vector: Column, label: Column) -> Column:
    """True for a labelled vector of finite components that are not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _rotated(units: np.ndarray) -> np.ndarray:
    """Rows times a seeded rotation, added up column by column.

    A row's result must not depend on the rows beside it, so no matrix product.
    """
    turn, _ = np.linalg.qr(np.random.default_rng(SEED).normal(size=(units.shape[1],) * 2))
    out = np.zeros_like(units)
    for k in range(units.shape[1]):
        out += units[:, k : k + 1] * turn[k]
    return out


def _blocks(dims: int) -> list[slice]:
    return [slice(lo, min(lo + BLOCK_DIMS, dims)) for lo in range(0, dims, BLOCK_DIMS)]


def _budget(block: slice, dims: int, threshold: float) -> float:
    """The block's share of the squared distance, in proportion to its dimensions."""
    return (2 - 2 * threshold) * (block.stop - block.start) / dims + SLACK


def _cells(frame: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    """Rows of a frame for every block and for the home and guest cells there."""
    for dims, part in frame.groupby("dims"):
        turned = _rotated(_units(np.array(part["vector"].tolist(), dtype=np.float64)))
        for number, block in enumerate(_blocks(dims)):
            radius = np.sqrt(_budget(block, dims, threshold))
            side = CELL_RADII * radius
            at = turned[:, block.start : min(block.start + 2, block.stop)]
            if at.shape[1] < 2:
                at = np.column_stack([at, np.zeros(len(at))])
            home = np.floor(at / side).astype(np.int64)
            border = at - home * side <= radius * (1 + 1e-9)
            for down_a in (0, 1):
                for down_b in (0, 1):
                    guest = (border[:, 0] if down_a else True) & (border[:, 1] if down_b else True) & np.ones(len(at), bool)
                    if guest.any():
                        yield part[guest].assign(
                            block=np.int32(number), cell_a=(home[guest, 0] - down_a).astype(np.int32), cell_b=(home[guest, 1] - down_b).astype(np.int32),
                            down_a=bool(down_a), down_b=bool(down_b),
                        )


def _pairs(rows: np.ndarray, others: np.ndarray, points: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs that may be within the budget, some at a time."""
    lengths = (points * points).sum(axis=1)
    step = max(1, PAIRS_AT_ONCE // max(1, len(others)))
    for start in range(0, len(rows), step):
        some = rows[start : start + step]
        away = lengths[some][:, None] + lengths[others][None, :] - 2 * points[some] @ points[others].T
        i, j = np.nonzero(away <= budget + SLACK)
        yield some[i], others[j]


def _joined(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links found in the cells of a frame: per class their number and a component."""
    group = group_numbers(frame, _KEYS)
    copies = frame["copies"].to_numpy()
    part, tile_a, tile_b, down_a, down_b = (frame[c].to_numpy() for c in ("part", "tile_a", "tile_b", "down_a", "down_b"))
    links, labels = np.zeros(len(frame), dtype=np.int64), np.arange(len(frame))
    starts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(frame))
    for lo, hi in zip(starts, starts[1:]):
        if hi - lo < 2:
            continue
        dims, number = int(frame["dims"].iat[lo]), int(frame["block"].iat[lo])
        units = _units(np.array(frame["vector"].iloc[lo:hi].tolist(), dtype=np.float64))
        turned, blocks = _rotated(units), _blocks(dims)
        rows, others = np.flatnonzero(part[lo:hi] == tile_a[lo]), np.flatnonzero(part[lo:hi] == tile_b[lo])
        same = tile_a[lo] == tile_b[lo]

        def near(i, j, k):
            gap = turned[i, blocks[k]] - turned[j, blocks[k]]
            return (gap * gap).sum(axis=1) <= _budget(blocks[k], dims, threshold)

        for i, j in _pairs(rows, others, turned[:, blocks[number]], _budget(blocks[number], dims, threshold)):
            ok = (i < j) if same else np.ones(len(i), bool)
            ok &= ~(down_a[lo + i] & down_a[lo + j]) & ~(down_b[lo + i] & down_b[lo + j])
            i, j = i[ok], j[ok]
            ok = (units[i] * units[j]).sum(axis=1) >= threshold
            i, j = i[ok], j[ok]
            ok = near(i, j, number)
            for earlier in range(number):
                ok &= ~near(i, j, earlier)
            i, j = lo + i[ok], lo + j[ok]
            if len(i):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                labels = local_labels(len(frame), i, j, labels)
    found = np.flatnonzero(links)
    cls = frame["cls"].to_numpy(dtype=object)
    return pd.DataFrame({"cls": cls[found], "links": links[found], "other": cls[labels[found]]})


def near_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """Rows (key, n_links, component_id, kept), one per input row.

    Vectors link when labels and lengths are equal and the cosine in double
    precision reaches the threshold.  Null, zero and non-finite vectors and null
    labels link with nothing and are their own component.  Repeated rows are
    linked copies.  A null key is kept; it never names a component.
    """
    col = lambda c: F.col(f"`{c}`")
    digest = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), col(label), col(vector))), 16, "0") for seed in (1, 2)])
    tagged = rows.select(col(key).alias("key"), F.when(usable(col(vector), col(label)), digest).alias("cls"), col(vector).alias("vector"), col(label).alias("label"))
    classes = materialize(
        tagged.where("cls is not null").groupBy("cls").agg(
            F.min("key").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
        ).withColumn("dims", F.size("vector")),
        "classes",
    )
    shape = "cls string, copies long, label " + dict(classes.dtypes)["label"] + ", vector " + dict(classes.dtypes)["vector"] + ", dims int, block int, cell_a int, cell_b int, down_a boolean, down_b boolean"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield from _cells(frame, threshold)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, _KEYS, TASK_ROWS):
            yield _joined(frame, threshold)

    members = classes.select("cls", "copies", "label", "vector", "dims").repartition("cls").mapInPandas(spread, shape)
    members = tiled(members, _KEYS[:5], "cls", CELL_ROWS).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = materialize(members.mapInPandas(join, "cls string, links long, other string"), "found")
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(found, "cls", "other").select(F.col("node").alias("cls"), "component")
    known = classes.select("cls", "first", "copies").join(totals, "cls", "left").join(linked, "cls", "left")
    known = materialize(known.withColumn("component", F.coalesce("component", "cls")), "known")
    lowest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = known.join(lowest, "component").select(F.col("cls").alias("of"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    slim = tagged.select("key", "cls")
    linked = slim.where("cls is not null").join(per_class, F.col("cls") == F.col("of")).select("key", "n_links", "component_id")
    alone = slim.where("cls is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
