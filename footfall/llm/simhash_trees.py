"""SimHash near-duplicates by sharded BK-trees.

Fingerprints that differ in at most r of 64 bits agree in all bits of some
choice of blocks - r of the blocks they are cut into.  Distinct fingerprints are
therefore sharded by each such choice; a shard builds a BK-tree, in which the
children of a node are keyed by their Hamming distance to it, and its members
search it, following only edges within r of their own distance to the node.
A shard's tree goes to every tile of its searchers.  A Spark broadcast of all
trees would put every fingerprint on the driver, so the trees travel by shuffle.
Exact: every pair within r meets in a shard.  A task passes on the components
of its shard, never its pairs, so a large group of near copies stays small.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from footfall.llm.arrays import expand, group_numbers, local_labels, whole_groups, word_blocks
from footfall.llm.common import bucket_split, identified, materialize
from footfall.llm.components import components
from footfall.llm.tiles import tiled

RADIUS = 3
# Shard members that one tree is meant to hold; larger shards are tiled.
TREE_ROWS = 2048
# Rows a task works on at a time, in many shards.
TASK_ROWS = 40_000
_KEYS = ["choice", "shard", "tile_a", "tile_b"]


def fingerprint(data: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as a signed integer; 0 without words."""
    if not data:
        return 0
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in word_blocks(data.lower()):
        words = tail + words
        if len(words) >= 3:
            hashes = np.fromiter((xxhash.xxh64_intdigest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            total += len(hashes)
        tail = words[-2:]
    if not total:
        if not tail:
            return 0
        value = xxhash.xxh64_intdigest(b" ".join(tail), 42)
    else:
        value = sum(1 << k for k in np.flatnonzero(2 * ones > total).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint) of all documents, whole texts; null and blank texts get 0."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col(f"`{key}`").alias(key), of(F.col(f"`{text}`").cast("binary")).alias("fingerprint"))


def _masks(count: int, radius: int) -> list[int]:
    """Bit masks of all choices of blocks, with blocks enough for small shards."""
    blocks = radius + 1
    while blocks < 2 * radius + 3 and count > 64 * 2 ** (64 * (blocks - radius) // blocks):
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """One BK-tree per group over arrays; the groups are numbered from 0."""

    def __init__(self, values: np.ndarray, group: np.ndarray, groups: int):
        self.values = values
        self.root = np.full(groups, -1)
        self.root[group[::-1]] = np.arange(len(values))[::-1]
        left = np.flatnonzero(self.root[group] != np.arange(len(values)))
        at = self.root[group[left]]
        edges, children = [], []
        while len(left):
            edge = at * 65 + np.bitwise_count(values[left] ^ values[at])
            edge, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            child = left[first]
            edges.append(edge)
            children.append(child)
            at = child[inverse]
            left, at = left[left != at], at[left != at]
        edges, children = np.concatenate(edges or [np.zeros(0, int)]), np.concatenate(children or [np.zeros(0, int)])
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def search(self, values: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (searcher, node) positions within the radius, level by level."""
        who = np.flatnonzero(self.root[group] >= 0)
        node = self.root[group[who]]
        while len(who):
            away = np.bitwise_count(values[who] ^ self.values[node]).astype(np.int64)
            hit = away <= radius
            yield who[hit], node[hit]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(away - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(away + radius, 64), "right")
            owner, edge = expand(low, high)
            who, node = who[owner], self.children[edge]


def _linked(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Members of the shards in a frame that are linked, with the component's first."""
    group = group_numbers(frame, _KEYS)
    values = frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
    part, a, b = (frame[c].to_numpy() for c in ("part", "tile_a", "tile_b"))
    tree, seek = np.flatnonzero(part == a), np.flatnonzero(part == b)
    forest = Forest(values[tree], group[tree], int(group[-1]) + 1)
    labels = np.arange(len(frame))
    for start in range(0, len(seek), 1024):
        some = seek[start : start + 1024]
        found = [(some[q], tree[n]) for q, n in forest.search(values[some], group[some], radius)]
        q, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
        apart = q != n
        if apart.any():
            labels = local_labels(len(frame), q[apart], n[apart], labels)
    moved = np.flatnonzero(labels != np.arange(len(frame)))
    return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[labels[moved]].view(np.int64)})


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within the radius.

    ``distinct`` has one column fp of distinct fingerprints.
    """
    masks = _masks(distinct.count(), radius)
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shard")) for i, m in enumerate(masks)])
    members = distinct.select("fp", F.explode(choices).alias("c")).select("fp", "c.choice", "c.shard")
    spread = tiled(members, ["choice", "shard"], "fp", TREE_ROWS)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, _KEYS, TASK_ROWS):
            yield _linked(frame, radius)

    ordered = spread.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return ordered.mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows (key, fingerprint, component_id): the smallest key reachable over links.

    One row per input row; repeated rows share everything.  A null key is kept
    and its component_id is the smallest non-null key it reaches, or null.
    """
    prints = materialize(fingerprints(docs, key, text), "prints")
    firsts = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("first")), "firsts")
    linked = components(near_links(firsts.select("fp")), "a", "b")
    member = firsts.join(linked, firsts["fp"] == linked["node"], "left").select("fp", "first", "component")
    alone = member.where("component is null").select("fp", F.col("first").alias("component_id"))
    grouped = materialize(member.where("component is not null"), "members")
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = alone.unionByName(grouped.join(lowest, "component").select("fp", "component_id"))
    return prints.join(ids, prints["fingerprint"] == ids["fp"]).select(key, "fingerprint", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest key.

    Every row is judged by its own text, also where rows share a key; of rows of a group that share the smallest key one
    stays.  A key that is null or no whole number counts as the largest.  Only documents that may go are shuffled.
    """
    named = identified(docs, key).withColumn("__place", F.struct("__doc", "__row"))
    found = near_duplicates(named, "__place", text)
    gone = materialize(found.where(F.col("__place") != F.col("component_id")).select("__place.*"), "near_copies")
    near, far = bucket_split(named, "__doc", gone)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return far.select(columns).unionByName(near.join(gone, ["__doc", "__row"], "left_anti").select(columns))
