"""Repeated strings of SPAN bytes by a sampled, range-partitioned suffix array.

Every byte that lies in a SPAN-byte string which also starts elsewhere goes.
Sorting every suffix would ship the corpus many times over, so suffixes are
sorted only where it may matter:

1. Each start is assigned an anchor, the position in the WINDOW bytes after it
   with the lowest hash.  Equal strings have equal anchors, and all strings of an
   anchor share the bytes from it to CONTEXT bytes on.  Anchors whose context
   occurs once cannot repeat.  If the whole stretch that an anchor's strings cover
   occurs twice, all of them repeat.
2. The strings of the other anchors, at the ends of repeated passages, become suffixes
   of two tokens, the hashes of their halves.  Sampled splitters range-partition them by
   leading tokens, with a tie-breaker, so that a frequent suffix spreads over
   buckets; a bucket sorts by multikey quicksort and compares neighbours; the
   first and last suffixes of the buckets are compared across boundaries.

Hashes of 128 bits stand for equality of strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from footfall.llm.common import bucket_split, materialize

SPAN = 400
WINDOW = 256
GRAM = 16
# Strings of an anchor that are judged together once more.
BLOCK = 16
# Starts of a long text that are looked at together; a power of two.
SLICE = 1 << 20
# Suffixes in a bucket.
BUCKET_ROWS = 500_000
# Odd multiplier of the rolling hash and of its last mix.
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ANCHOR = "doc long, tag int, anchor long, low long, high long, key long, cover long"
_BLOCK = _ANCHOR + ", wanted boolean"
_SUFFIX = "doc long, tag int, start long, first long, second long, wanted boolean"
_SORTED = "doc long, tag int, start long, first long, second long, wanted boolean, repeats boolean, edge boolean"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from prefix and suffix minima of blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _anchors(data: bytes, span: int, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, first start, last start, hash of the context, hash of all that its strings cover)."""
    context = span - window + 1
    for base in range(0, len(data) - span + 1, SLICE):
        part = np.frombuffer(data[base : base + SLICE + span - 1], dtype=np.uint8).astype(np.uint64)
        starts = len(part) - span + 1
        grams, width, power = part, 1, _BASE
        while width < GRAM:
            grams = grams[:-width] * np.uint64(power) + grams[width:]
            width, power = 2 * width, power * power & 0xFFFFFFFFFFFFFFFF
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(_MIX)
        grams = grams[: starts + window - 1]
        ranked = (grams & ~np.uint64(2 * SLICE - 1)) | np.arange(len(grams), dtype=np.uint64)
        at = (_window_minima(ranked, window) & np.uint64(2 * SLICE - 1)).astype(np.int64)
        lows = np.flatnonzero(np.diff(at, prepend=-1))
        for low, high in zip((base + lows).tolist(), (base + np.append(lows[1:], starts) - 1).tolist()):
            anchor = base + int(at[low - base])
            yield anchor, low, high, _signed(xxhash.xxh64_intdigest(data[anchor : anchor + context])), _signed(xxhash.xxh64_intdigest(data[low : high + span], seed=1))


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Identity and bytes of the documents: rows that repeat a key differ by the tag of their text."""
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(_doc(key).alias("doc"), F.hash(data).alias("tag"), data.alias("data"))


def _doc(key: str):
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit((1 << 63) - 1))


def anchors(slim: DataFrame, span: int, window: int) -> DataFrame:
    names = [f.split()[0] for f in _ANCHOR.split(", ")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, tag, data in batch.itertuples(index=False):
                for found in _anchors(data, span, window):
                    rows.append((doc, tag, *found))
                    if len(rows) >= 100_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(find, _ANCHOR)


def _judged(found: DataFrame) -> DataFrame:
    """Stretches whose key occurs twice or more: n like theirs, kinds of them with this key, first of its kind."""
    place = F.struct("doc", "tag", "low")
    stretches = found.groupBy("key", "cover").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep"))
    contexts = stretches.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).where("total > 1").drop("total")
    known = stretches.join(contexts, "key")
    return found.join(known, ["key", "cover"]).withColumn("is_rep", place == F.col("rep")).drop("rep", "key", "cover")


def _settled(judged: DataFrame, span: int) -> DataFrame:
    """Byte ranges of the wanted stretches that occur twice as a whole."""
    return judged.where("wanted and n > 1").select("doc", "tag", "low", (F.col("high") + span).alias("high"))


def _open(judged: DataFrame) -> DataFrame:
    """Stretches that may repeat in part, and one of each kind that they may meet."""
    rows = judged.where("kinds > 1 and (n = 1 or is_rep)")
    return rows.select("doc", "tag", "anchor", "low", "high", (F.col("wanted") & (F.col("n") == 1)).alias("wanted"))


def _with_texts(slim: DataFrame, stretches: DataFrame) -> DataFrame:
    """Documents that have stretches, with the list of them."""
    per_doc = stretches.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_set(F.struct("anchor", "low", "high", "wanted")).alias("stretches"))
    per_doc = materialize(per_doc, "stretches")
    near, _ = bucket_split(slim, "doc", per_doc.select(F.col("__doc").alias("doc")))
    return near.join(per_doc, (F.col("doc") == F.col("__doc")) & (F.col("tag") == F.col("__tag"))).select("doc", "tag", "data", "stretches")


def _blocks(slim: DataFrame, stretches: DataFrame, span: int) -> DataFrame:
    """The strings of open anchors in blocks, counted from the anchor.

    A block's key is the hash of the bytes that all strings of a full block share, so
    it does not depend on where the stretch begins; its cover is that of the strings it has.
    """
    digest, names = xxhash.xxh64_intdigest, [f.split()[0] for f in _BLOCK.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, tag, data, found in batch.itertuples(index=False):
                for s in found:
                    anchor, first, last = s["anchor"], s["low"], s["high"]
                    for base in range(anchor + (first - anchor) // BLOCK * BLOCK, last + 1, BLOCK):
                        low, high = max(first, base), min(last, base + BLOCK - 1)
                        key = digest(data[base + BLOCK - 1 : base + span], seed=base - anchor & 0xFFFFFFFF)
                        cover = digest(data[low : high + span], seed=(low - base) * BLOCK + high - low)
                        rows.append((doc, tag, anchor, low, high, _signed(key), _signed(cover), s["wanted"]))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return _with_texts(slim, stretches).mapInPandas(cut, _BLOCK)


def _suffixes(slim: DataFrame, stretches: DataFrame, span: int) -> DataFrame:
    """A row per string of the open blocks with the tokens of its halves."""
    half, names = span // 2, [f.split()[0] for f in _SUFFIX.split(", ")]
    digest = xxhash.xxh64_intdigest

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, tag, data, found in batch.itertuples(index=False):
                for s in found:
                    for p in range(s["low"], s["high"] + 1):
                        rows.append((doc, tag, p, _signed(digest(data[p : p + half])), _signed(digest(data[p + half : p + span])), s["wanted"]))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return _with_texts(slim, stretches).mapInPandas(cut, _SUFFIX)


def multikey_order(tokens: list[np.ndarray]) -> np.ndarray:
    """Order of suffixes by their tokens: three-way partition on a token, equal parts go on to the next."""
    out, todo, filled = np.empty(len(tokens[0]), dtype=np.int64), [(np.arange(len(tokens[0])), 0)], 0
    while todo:
        rows, depth = todo.pop()
        if len(rows) < 2 or depth == len(tokens):
            out[filled : filled + len(rows)] = rows
            filled += len(rows)
            continue
        values = tokens[depth][rows]
        if len(rows) <= 4096:
            rows = rows[np.argsort(values, kind="stable")]
            edges = np.flatnonzero(np.diff(tokens[depth][rows])) + 1
            if not len(edges):
                todo.append((rows, depth + 1))
            elif len(edges) == len(rows) - 1:
                todo.append((rows, len(tokens)))
            else:
                todo += [(r, depth + 1) for r in np.split(rows, edges)[::-1]]
            continue
        pivot = np.partition(values, len(values) // 2)[len(values) // 2]
        todo += [(rows[values > pivot], depth), (rows[values == pivot], depth + 1), (rows[values < pivot], depth)]
    return out


def _bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """Suffixes of a bucket that equal a neighbour, and one of its first and of its last."""
    tokens = [frame["first"].to_numpy(), frame["second"].to_numpy()]
    frame = frame.iloc[multikey_order(tokens)].reset_index(drop=True)
    equal = ((frame[["first", "second"]].shift() == frame[["first", "second"]]).all(axis=1)).to_numpy()
    repeats = equal | np.append(equal[1:], False)
    edge = np.zeros(len(frame), dtype=bool)
    edge[[0, -1]] = True
    keep = (repeats & frame["wanted"].to_numpy()) | edge
    return frame.assign(repeats=repeats, edge=edge)[keep]


def repeated_starts(suffixes: DataFrame) -> DataFrame:
    """Rows (doc, tag, start) of the wanted suffixes that occur twice or more."""
    suffixes = materialize(suffixes, "suffixes")
    buckets = -(-max(1, suffixes.count()) // BUCKET_ROWS)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if frames:
            yield _bucket(pd.concat(frames, ignore_index=True))

    ranged = suffixes.repartitionByRange(buckets, "first", "second", F.xxhash64("doc", "start"))
    found = materialize(ranged.mapInPandas(sort, _SORTED), "sorted")
    edges = found.where("edge")
    across = edges.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = edges.where("wanted and not repeats").join(across, ["first", "second"])
    return found.where("repeats and wanted").select("doc", "tag", "start").unionByName(late.select("doc", "tag", "start"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """Rows (doc, tag, spans): per document the byte ranges that repeat elsewhere, not merged."""
    slim = _slim(docs, key, text)
    found = materialize(anchors(slim, span, window), "anchors")
    judged = materialize(_judged(found.withColumn("wanted", F.lit(True))), "judged")
    blocks = materialize(_judged(materialize(_blocks(slim, _open(judged), span), "blocks")), "judged_blocks")
    starts = repeated_starts(_suffixes(slim, _open(blocks), span))
    parts = starts.select("doc", "tag", F.col("start").alias("low"), (F.col("start") + span).alias("high"))
    whole = _settled(judged, span).unionByName(_settled(blocks, span))
    return whole.unionByName(parts).groupBy("doc", "tag").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching ranges."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, window: int = WINDOW) -> DataFrame:
    """``docs`` with __bytes (long), __runs (removed byte ranges) and __kept (binary).

    Texts are UTF-8 bytes, so what is kept may cut a character.  Null and short
    texts lose nothing; a null text has empty __kept.  Rows that repeat a key are
    documents of their own, and each copy makes the other's strings repeat.  Other columns
    stay, but for names that begin with two underscores.
    """
    gone = materialize(repeated_spans(docs, key, text, span, window).withColumnsRenamed({"doc": "__doc", "tag": "__tag", "spans": "__spans"}), "spans")
    data = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    tagged = docs.withColumns({"__id": _doc(key), "__data": data})
    near, far = bucket_split(tagged, "__id", gone.select(F.col("__doc").alias("__id")))
    runs = "array<struct<low:bigint,high:bigint>>"

    @pandas_udf(T.StructType([T.StructField("runs", T._parse_datatype_string(runs)), T.StructField("kept", T.BinaryType())]))
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for data, ranges in zip(texts, spans):
            out_runs = merged(ranges if ranges is not None else [])
            edges = [0, *[x for r in out_runs for x in r], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append(([{"low": a, "high": b} for a, b in out_runs], kept))
        return pd.DataFrame(out, columns=["runs", "kept"])

    near = near.join(gone, (F.col("__id") == F.col("__doc")) & (F.hash("__data") == F.col("__tag")), "left").withColumn("__cut", cut("__data", "__spans"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    size = F.octet_length("__data").cast("long").alias("__bytes")
    near = near.select(*columns, size, F.col("__cut.runs").alias("__runs"), F.col("__cut.kept").alias("__kept"))
    far = far.select(*columns, size, F.array().cast(runs).alias("__runs"), F.col("__data").alias("__kept"))
    return far.unionByName(near)
